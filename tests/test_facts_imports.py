"""P3 parse facts and the import-breakage warnings."""


from helpers import raw_df
from treeline.operators import facts as FA
from treeline.operators import files as FL
from treeline.operators import imports as IM


def test_parse_python_rules():
    src = (
        "import os, sys as system\n"
        "from . import sibling\n"
        "from .utils import a, b\n"
        "from ...pkg.mod import x as y\n"
        "def test_outer():\n"
        "    import json\n"
        "async def test_async():\n"
        "    pass\n"
        "class TestThing:\n"
        "    pass\n"
        "if __name__ == '__main__':\n"
        "    from collections import (\n"
        "        OrderedDict,\n"
        "    )\n"
    )
    imports, has_main, has_tests, stmts = FA.parse_python(src)
    # breadth first: top-level statements, then nested ones
    assert imports == ["os", "sys", "utils", "pkg.mod", "json", "collections"]
    assert has_main and has_tests
    assert [(s["module"], s["is_relative"], s["level"], s["names"]) for s in stmts[:5]] == [
        ("os", False, 0, []), ("sys", False, 0, []), ("", True, 1, ["sibling"]),
        ("utils", True, 1, ["a", "b"]), ("pkg.mod", True, 3, ["x"])]
    assert FA.parse_python("def broken(:\n") == ([], False, False, [])
    assert FA.parse_python("async def test_x():\n    pass\n")[2] is False
    assert FA.parse_python("x = '\x00'")[0] == []


def _repo(spark):
    contents = {
        "src/main.py": "\nfrom .utils import helper_function\nfrom .models import User\nimport config\n",
        "src/utils.py": "\ndef helper_function():\n    pass\n",
        "src/models.py": "\nfrom utils import helper_function\nimport constants\n",
        "src/config.py": "\nDATABASE_URL = 'sqlite:///db.sqlite3'\n",
        "src/constants.py": "\nMAX_SIZE = 100\n",
    }
    raw = raw_df(spark, list(contents), contents=contents)
    return raw, FL.build_files(raw)


def _moves(spark, pairs):
    return spark.createDataFrame([("r1", i, "move", s, t) for i, (s, t) in enumerate(pairs)],
                                 "repo_id string, ord bigint, action string, source string, target string")


def test_import_warnings_reference_fixture(spark):
    raw, files = _repo(spark)
    mv = _moves(spark, [("src/main.py", "scripts/main.py"), ("src/models.py", "lib/models.py")])
    w = IM.import_warnings(mv, files, raw).orderBy("move_ord", "stmt_no").collect()
    got = [(r["source"], r["line_number"], r["import_text"], r["reason"], r["affected"]) for r in w]
    assert got == [
        ("src/main.py", 2, "from .utils import helper_function",
         "Relative import will break when moving from src/ to scripts/", ["utils.py"]),
        ("src/main.py", 3, "from .models import User",
         "Relative import will break when moving from src/ to scripts/", ["models.py"]),
        ("src/main.py", 4, "import config",
         "Importing 'config' from current directory, but moving away from src/", ["src/config.py"]),
        ("src/models.py", 2, "from utils import helper_function",
         "Importing 'utils' from current directory, but moving away from src/", ["src/utils.py"]),
        ("src/models.py", 3, "import constants",
         "Importing 'constants' from current directory, but moving away from src/", ["src/constants.py"]),
    ]


def test_sibling_moving_along_or_elsewhere(spark):
    raw, files = _repo(spark)
    along = _moves(spark, [("src/models.py", "lib/models.py"), ("src/utils.py", "lib/utils.py"),
                           ("src/constants.py", "etc/constants.py")])
    w = IM.import_warnings(along, files, raw).collect()
    reasons = sorted(r["reason"] for r in w if r["source"] == "src/models.py")
    assert reasons == ["Importing 'constants' from same directory, but constants.py is moving to etc/"]
    same_dir = _moves(spark, [("src/main.py", "src/app.py")])
    assert IM.import_warnings(same_dir, files, raw).count() == 0
