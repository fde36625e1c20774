"""DuckDB oracle: the same rules, written as plain SQL over the fixture CTEs.

Written from the rule text (SURVEY 2.11), not from the Column code. Each
oracle query is ``WITH <fixture and layer CTEs> SELECT ...``; ``layers(...)``
assembles only the CTEs a query needs, in dependency order.
"""

from __future__ import annotations

import re

from treeline.functions import constants as K
from treeline.sources.fixtures import ORACLE_FIXTURE_CTES


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _t(template: str, **exprs) -> str:
    """A fixed message template as SQL: quoted literal pieces || (expression)."""
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append(_q(template[pos:m.start()]))
        out.append(f"({exprs[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        out.append(_q(template[pos:]))
    return " || ".join(out)


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _glob_re(patterns) -> str:
    return "^(?:" + "|".join(p.replace(".", "\\.").replace("*", ".*") for p in patterns) + ")$"


_SUFFIX = "'^.+\\.[^.]+$'"


def _dir_hit(s: str) -> str:
    names = sorted({n.lower() for n in K.IGNORE_DIR_NAMES})
    sub = "(?:" + "|".join(n.replace(".", "\\.") for n in names) + ")"
    return (f"({s} IN {_in(K.ARTIFACT_DIRS)} OR regexp_matches(lower({s}), {_q(sub)}) "
            f"OR regexp_matches({s}, {_q(_glob_re(K.IGNORE_DIR_GLOBS))}))")


def _pat_hit(s: str) -> str:
    return f"regexp_matches({s}, {_q(_glob_re(K.IGNORE_FILE_PATTERNS))})"


def _any_prefix(s: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({s}, {_q(p)})" for p in prefixes) + ")"


def _any_contains(s: str, words) -> str:
    return "(" + " OR ".join(f"contains({s}, {_q(w)})" for w in words) + ")"


# ---------------------------------------------------------------------------
# layers: name -> (dependencies, SELECT text)
# ---------------------------------------------------------------------------
L: dict[str, tuple[list[str], str]] = {}

L["raw"] = (["inv"], """
SELECT repo_id, file_seq, relative_path, size, content,
       string_split(relative_path, '/') AS parts,
       len(string_split(relative_path, '/')) AS depth,
       string_split(relative_path, '/')[-1] AS name,
       regexp_extract(string_split(relative_path, '/')[-1], '^.+(\\.[^.]+)$', 1) AS extension,
       CASE WHEN len(string_split(relative_path, '/')) > 1
            THEN array_to_string(string_split(relative_path, '/')[1:len(string_split(relative_path, '/')) - 1], '/')
            ELSE '.' END AS parent
FROM inv
""")

L["kept"] = (["raw"], f"""
SELECT * FROM raw
WHERE NOT (
  len(list_filter(parts[1:depth - 1], lambda s: {_dir_hit('s')} OR (regexp_matches(s, {_SUFFIX}) AND {_pat_hit('s')}))) > 0
  OR CASE WHEN regexp_matches(name, {_SUFFIX}) THEN {_pat_hit('name')} ELSE {_dir_hit('name')} END)
""")

# one row per line of every kept .py file (the fixture's text is top-level only)
L["pylines"] = (["kept"], """
SELECT repo_id, file_seq, relative_path, i AS line_no, string_split(content, chr(10))[i] AS line,
       contains(content, 'def broken(') AS broken
FROM (SELECT *, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM kept WHERE extension = '.py')
""")

# statements per line: 'import a, b as c' -> one per module; 'from ..m import x, y' -> one
L["stmt_rows"] = (["pylines"], """
SELECT repo_id, file_seq, relative_path, line_no, j AS part_no,
       split_part(trim(string_split(regexp_extract(line, '^import (.+)$', 1), ',')[j]), ' ', 1) AS module,
       false AS is_relative, 0 AS level, []::VARCHAR[] AS names
FROM (SELECT *, generate_subscripts(string_split(regexp_extract(line, '^import (.+)$', 1), ','), 1) AS j
      FROM pylines WHERE NOT broken AND regexp_matches(line, '^import '))
UNION ALL
SELECT repo_id, file_seq, relative_path, line_no, 1 AS part_no,
       regexp_extract(line, '^from \\.*([^ ]*) import', 1) AS module,
       length(regexp_extract(line, '^from (\\.*)', 1)) > 0 AS is_relative,
       length(regexp_extract(line, '^from (\\.*)', 1)) AS level,
       list_transform(string_split(regexp_extract(line, ' import (.+)$', 1), ','),
                      lambda x: split_part(trim(x), ' ', 1)) AS names
FROM pylines WHERE NOT broken AND regexp_matches(line, '^from ')
""")

L["facts"] = (["kept", "pylines", "stmt_rows"], """
SELECT k.repo_id, k.file_seq,
  coalesce((SELECT list(s.module ORDER BY s.line_no, s.part_no) FROM stmt_rows s
            WHERE s.repo_id = k.repo_id AND s.file_seq = k.file_seq AND s.module <> ''), []::VARCHAR[]) AS imports,
  coalesce((SELECT bool_or(regexp_matches(p.line, '^if __name__ ')) FROM pylines p
            WHERE p.repo_id = k.repo_id AND p.file_seq = k.file_seq AND NOT p.broken), false) AS ast_main,
  coalesce((SELECT bool_or(regexp_matches(p.line, '^(def test_|class Test)')) FROM pylines p
            WHERE p.repo_id = k.repo_id AND p.file_seq = k.file_seq AND NOT p.broken), false) AS ast_tests
FROM kept k
""")

L["pkgdirs"] = (["raw"], """
SELECT DISTINCT repo_id, parent FROM raw WHERE name = '__init__.py'
""")

L["files"] = (["kept", "facts", "pkgdirs"], f"""
SELECT k.repo_id, k.file_seq, k.relative_path, k.size, k.parts, k.depth, k.name, k.extension, k.parent,
       CASE WHEN k.extension = '.py' THEN substring(k.content, 1, 500) ELSE '' END AS content_sample,
       f.imports, f.ast_main AS has_main,
       f.ast_main OR {_any_prefix('lower(k.name)', K.EXECUTABLE_NAME_PREFIXES)} AS is_executable,
       f.ast_tests OR starts_with(lower(k.name), 'test_') OR ends_with(lower(k.name), '_test.py') AS has_tests,
       (k.depth > 1 AND p.parent IS NOT NULL) AS in_package
FROM kept k JOIN facts f USING (repo_id, file_seq)
LEFT JOIN pkgdirs p ON p.repo_id = k.repo_id AND p.parent = k.parent
""")

_lp = "list_transform(parts, lambda p: lower(p))"
_exp = (f"({_any_prefix('lower(name)', K.EXPERIMENT_PREFIXES)} "
        f"OR replace(lower(name), '.py', '') IN {_in(K.EXPERIMENT_STEMS)} "
        f"OR {_any_contains('lower(name)', K.EXPERIMENT_NAME_WORDS)} "
        f"OR len(list_filter({_lp}, lambda p: {_any_contains('p', K.EXPERIMENT_PATH_WORDS)})) > 0 "
        f"OR starts_with(lower(name), 'untitled') OR ends_with(lower(name), '.bak'))")
_test = (f"(len(list_filter({_lp}, lambda p: contains(p, 'test'))) > 0 OR has_tests "
         f"OR starts_with(lower(name), 'test_') OR ends_with(lower(name), '_test.py') "
         f"OR len(list_filter(imports, lambda i: i IN {_in(K.TEST_IMPORTS)})) > 0)")
_cfg = (f"(name IN {_in(K.CONFIG_NAMES)} OR ends_with(lower(name), '_config.py') OR lower(name) = 'config.py' "
        f"OR lower(name) = 'settings.py' OR ends_with(lower(name), '_settings.py'))")
_script = (f"(is_executable OR {_any_prefix('lower(name)', K.SCRIPT_PREFIXES)} "
           f"OR list_contains({_lp}, 'scripts'))")
_src = (f"(list_contains({_lp}, 'src') OR in_package "
        f"OR len(list_filter(imports, lambda i: {_any_contains('i', K.APP_IMPORTS)})) > 0 "
        f"OR len(imports) > 2)")

L["classified"] = (["files"], f"""
SELECT *, CASE
  WHEN extension = '.md' THEN 'markdown'
  WHEN extension <> '.py' THEN CASE
      WHEN name IN {_in(K.CONFIG_NAMES)} THEN 'configs'
      WHEN extension IN {_in(K.DATA_EXTENSIONS)} THEN 'data'
      WHEN extension IN {_in(K.CONFIG_EXTENSIONS)} THEN 'configs'
      WHEN extension IN {_in(K.DOC_EXTENSIONS)} THEN 'docs'
      ELSE 'unknown' END
  WHEN {_exp} THEN 'experiments'
  WHEN {_test} THEN 'tests'
  WHEN {_cfg} THEN 'configs'
  WHEN {_script} THEN 'scripts'
  WHEN {_src} THEN 'src'
  ELSE 'trash' END AS category
FROM files
""")

L["repo_list"] = (["inv"], "SELECT DISTINCT repo_id FROM inv")

L["types"] = (["repo_list", "files"], f"""
SELECT r.repo_id, CAST(coalesce(a.total_files, 0) AS BIGINT) AS total_files,
       CAST(coalesce(a.py_files, 0) AS BIGINT) AS py_files,
       CAST(coalesce(a.py_files, 0) AS DOUBLE) / CAST(greatest(coalesce(a.total_files, 0), 1) AS DOUBLE) * 100.0 AS py_percentage,
       CAST(coalesce(a.py_root, 0) * 2 + CASE WHEN coalesce(a.py_files, 0) > 10 THEN 3
            WHEN coalesce(a.py_files, 0) > 5 THEN 2 WHEN coalesce(a.py_files, 0) > 0 THEN 1 ELSE 0 END AS BIGINT)
         AS python_score,
       CAST((CASE WHEN coalesce(a.fe, 0) > 0 THEN 3 ELSE 0 END) + (CASE WHEN coalesce(a.java, 0) > 0 THEN 3 ELSE 0 END)
          + (CASE WHEN coalesce(a.go, 0) > 0 THEN 3 ELSE 0 END) + (CASE WHEN coalesce(a.ruby, 0) > 0 THEN 3 ELSE 0 END)
          + (CASE WHEN coalesce(a.dotnet, 0) > 0 THEN 3 ELSE 0 END)
          + (CASE WHEN coalesce(a.tsjs, 0) > 20 THEN 2 WHEN coalesce(a.tsjs, 0) > 10 THEN 1 ELSE 0 END) AS BIGINT)
         AS non_python_score
FROM repo_list r LEFT JOIN (
  SELECT repo_id, count(*) AS total_files, count(*) FILTER (WHERE extension = '.py') AS py_files,
    count(DISTINCT name) FILTER (WHERE depth = 1 AND name IN {_in(K.PYTHON_ROOT_FILES)}) AS py_root,
    count(*) FILTER (WHERE depth = 1 AND name IN {_in(K.FRONTEND_ROOT_FILES)}) AS fe,
    count(*) FILTER (WHERE depth = 1 AND name IN {_in(K.JAVA_ROOT_FILES)}) AS java,
    count(*) FILTER (WHERE depth = 1 AND name IN {_in(K.GO_ROOT_FILES)}) AS go,
    count(*) FILTER (WHERE depth = 1 AND name IN {_in(K.RUBY_ROOT_FILES)}) AS ruby,
    count(*) FILTER (WHERE extension IN {_in(K.DOTNET_EXTENSIONS)}) AS dotnet,
    count(*) FILTER (WHERE extension IN {_in(K.TS_JS_EXTENSIONS)}) AS tsjs
  FROM files GROUP BY repo_id) a USING (repo_id)
""")

L["repo_types"] = (["types"], """
SELECT *, CASE WHEN python_score >= 3 AND py_percentage >= 50 THEN 'python_dominant'
               WHEN non_python_score >= 2 AND py_percentage < 20 THEN 'non_python'
               WHEN py_percentage >= 30 THEN 'mixed' ELSE 'non_python' END AS repo_type
FROM types
""")


FIXTURE_DEPS = {"inv": [], "history": [], "history_files": ["history"], "git_status": ["inv"],
                "git_tracked": ["inv"], "repos": ["inv"], "decisions": ["inv"]}


_WALK = "len(string_split(relative_path, '/')), string_split(relative_path, '/')"


def layers(*names: str, by_path: bool = False) -> str:
    """``WITH`` clause holding the fixture CTEs and the named layers (+ deps).

    ``by_path``: files are numbered by depth and segments of their paths instead.
    """
    fixture = dict(ORACLE_FIXTURE_CTES)
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps = L[n][0] if n in L else FIXTURE_DEPS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        text = fixture[n] if n in fixture else L[n][1]
        if n == "inv" and by_path:
            parts.append(f"listed AS (\n{text}\n)")
            text = (f"SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY {_WALK}) AS file_seq, "
                    "relative_path, size, content FROM listed")
        parts.append(f"{n} AS (\n{text}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# oracle queries
# ---------------------------------------------------------------------------
ORACLE: dict[str, str] = {}


def _o(name: str, deps: list[str], select: str) -> None:
    ORACLE[name] = layers(*deps) + select


_o("S2_read_inventory", ["inv"], "SELECT repo_id, file_seq, relative_path, size FROM inv")
ORACLE["S2_without_file_seq"] = (
    layers("inv", by_path=True) + "SELECT repo_id, file_seq AS position, relative_path, size FROM inv")
_o("S6_file_records", ["classified"], """
SELECT repo_id, relative_path, name, extension, size, array_to_string(imports, '|') AS imports,
       is_executable, has_main, has_tests FROM classified""")
_o("P1_path_parts", ["classified"], """
SELECT repo_id, relative_path, name, extension, parent, CAST(depth AS BIGINT) AS depth,
       array_to_string(parts, '|') AS parts, content_sample FROM classified""")
_o("P2_name_flags", ["classified"], f"""
SELECT repo_id, relative_path, {_any_prefix('lower(name)', K.EXECUTABLE_NAME_PREFIXES)} AS name_executable,
       starts_with(lower(name), 'test_') OR ends_with(lower(name), '_test.py') AS name_tests,
       is_executable, has_tests FROM classified""")
_o("P3_python_facts", ["classified"], """
SELECT repo_id, relative_path, array_to_string(imports, '|') AS imports, CAST(len(imports) AS BIGINT) AS n_imports,
       has_main, has_tests, is_executable FROM classified WHERE extension = '.py'""")
_o("P3_import_statements", ["stmt_rows"], """
SELECT repo_id, relative_path,
       CAST(row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY line_no, part_no) - 1 AS BIGINT) AS stmt_no,
       module, is_relative, CAST(level AS BIGINT) AS level, CAST(line_no AS BIGINT) AS line_number,
       array_to_string(names, '|') AS names FROM stmt_rows""")
_o("P4_classify", ["classified"], "SELECT repo_id, relative_path, category FROM classified")
_o("P5_is_experiment", ["classified"],
   f"SELECT repo_id, relative_path, {_exp} AS is_experiment FROM classified WHERE extension = '.py'")
_o("P6_is_test", ["classified"],
   f"SELECT repo_id, relative_path, {_test} AS is_test FROM classified WHERE extension = '.py'")
_o("P7_is_config", ["classified"],
   f"SELECT repo_id, relative_path, {_cfg} AS is_config FROM classified WHERE extension = '.py'")
_o("P8_is_script", ["classified"],
   f"SELECT repo_id, relative_path, {_script} AS is_script FROM classified WHERE extension = '.py'")
_o("P9_is_source", ["classified"],
   f"SELECT repo_id, relative_path, {_src} AS is_source FROM classified WHERE extension = '.py'")
_o("P10_classify_non_python", ["classified"], """
SELECT repo_id, relative_path, category FROM classified WHERE extension NOT IN ('.py', '.md')""")
_o("F1_not_ignored", ["raw", "kept"], """
SELECT r.repo_id, r.relative_path, k.relative_path IS NULL AS ignored
FROM raw r LEFT JOIN kept k USING (repo_id, file_seq)""")
_o("F2_glob_match", ["raw"], "\nUNION ALL\n".join(
    f"""SELECT DISTINCT repo_id, relative_path, seg AS segment, {_q(p)} AS pattern
FROM (SELECT repo_id, relative_path, unnest(parts) AS seg FROM raw)
WHERE {('seg = ' + _q(p)) if '*' not in p else 'regexp_matches(seg, ' + _q(_glob_re([p])) + ')'}"""
    for p in K.IGNORE_FILE_PATTERNS + K.IGNORE_DIR_GLOBS))
_o("A1_repo_summary", ["classified", "repo_list"], """
SELECT repo_id, count(relative_path) AS total_files, count(*) FILTER (WHERE extension = '.py') AS python_files,
       count(*) FILTER (WHERE is_executable) AS executables, count(*) FILTER (WHERE has_tests) AS test_files
FROM repo_list LEFT JOIN classified USING (repo_id) GROUP BY repo_id""")
_o("A2_extension_histogram", ["classified"], """
SELECT repo_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS extension,
       count(*) AS file_count FROM classified GROUP BY ALL""")
ORACLE["A3_category_counts"] = layers("classified", "repo_list") + "SELECT repo_id, " + ", ".join(
    f"count(*) FILTER (WHERE category = {_q(c)}) AS {c}" for c in K.CATEGORIES) \
    + " FROM repo_list LEFT JOIN classified USING (repo_id) GROUP BY repo_id"
_o("A4_python_score", ["repo_types"], "SELECT repo_id, py_files, python_score FROM repo_types")
_o("A5_non_python_score", ["repo_types"], "SELECT repo_id, non_python_score FROM repo_types")
_o("A6_repo_type", ["repo_types"], "SELECT * FROM repo_types")
_o("A7_detection_summary", ["classified"], f"""
SELECT repo_id, 'extension' AS kind, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS value,
       count(*) AS n FROM classified GROUP BY ALL
UNION ALL SELECT DISTINCT repo_id, 'root_file', name, CAST(1 AS BIGINT) FROM classified WHERE depth = 1
UNION ALL SELECT DISTINCT repo_id, 'python_root_file', name, CAST(1 AS BIGINT) FROM classified
  WHERE depth = 1 AND name IN {_in(K.PYTHON_ROOT_FILES)}
UNION ALL SELECT DISTINCT repo_id, 'frontend_root_file', name, CAST(1 AS BIGINT) FROM classified
  WHERE depth = 1 AND name IN {_in(K.FRONTEND_ROOT_FILES)}""")
_o("L1_top_extensions", ["classified"], """
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, extension) AS rank
FROM (SELECT repo_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS extension,
             count(*) AS file_count FROM classified GROUP BY ALL)""")
_o("U3_root_indicators", ["classified"], f"""
SELECT repo_id,
  coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IN {_in(K.PYTHON_ROOT_FILES)})), '|'), '') AS python_root_files,
  coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IN {_in(K.FRONTEND_ROOT_FILES)})), '|'), '') AS frontend_root_files,
  coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IN {_in(K.JAVA_ROOT_FILES + K.GO_ROOT_FILES + K.RUBY_ROOT_FILES)})), '|'), '') AS other_root_files
FROM classified WHERE depth = 1 GROUP BY repo_id""")
_o("J1_in_package", ["classified"], "SELECT repo_id, relative_path, in_package FROM classified")


# ---------------------------------------------------------------- proposals
def _first_match(expr_pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in expr_pairs) + f" ELSE {default} END"


_loc = "CASE WHEN parent = '.' THEN 'repository root' ELSE parent END"
_tfw = f"list_filter(imports, lambda i: i IN {_in(K.TEST_IMPORTS)})"
_cfg_kind = _first_match([(f"contains(name, {_q(p)})", _q(k)) for p, k in K.CONFIG_KINDS])
_data_kind = _first_match([(f"extension = {_q(e)}", _q(k)) for e, k in K.DATA_KINDS])
_reason = f"""CASE category
  WHEN 'tests' THEN concat_ws('. ',
     CASE WHEN has_tests THEN {_t(K.REASON_TEST_FUNCTIONS)} END,
     CASE WHEN len({_tfw}) > 0 THEN {_t(K.REASON_TEST_IMPORTS, frameworks=f"array_to_string({_tfw}[1:2], ', ')")} END,
     CASE WHEN starts_with(name, 'test_') OR ends_with(name, '_test.py') THEN {_t(K.REASON_TEST_NAMING)} END,
     CASE WHEN {_loc} NOT IN ('tests', 'test') THEN {_t(K.REASON_TEST_LOCATION, location=_loc)} END)
  WHEN 'src' THEN concat_ws('. ',
     CASE WHEN len(imports) > 0 THEN {_t(K.REASON_SRC_IMPORTS, n='CAST(len(imports) AS VARCHAR)')} END,
     CASE WHEN len(imports) > 5 THEN {_t(K.REASON_SRC_MANY)} END,
     CASE WHEN NOT has_tests AND NOT is_executable THEN {_t(K.REASON_SRC_LIBRARY)} END,
     CASE WHEN parent = '.' THEN {_t(K.REASON_SRC_ROOT)} END)
  WHEN 'scripts' THEN concat_ws('. ',
     CASE WHEN is_executable THEN {_t(K.REASON_SCRIPT_MAIN)} END,
     CASE WHEN name IN {_in(K.COMMON_SCRIPT_NAMES)} THEN {_t(K.REASON_SCRIPT_NAME)} END,
     CASE WHEN parent = '.' THEN {_t(K.REASON_SCRIPT_ROOT)} END)
  WHEN 'configs' THEN concat_ws('. ',
     coalesce({_t(K.REASON_CONFIG_KIND, kind=_cfg_kind)}, {_t(K.REASON_CONFIG_DEFAULT)}),
     CASE WHEN name IN {_in(K.STANDARD_ROOT_CONFIGS)} THEN {_t(K.REASON_CONFIG_ROOT)}
          WHEN {_loc} NOT IN ('configs', 'config') THEN {_t(K.REASON_CONFIG_MOVE)} END)
  WHEN 'experiments' THEN concat_ws('. ',
     CASE WHEN contains(lower(name), 'test') OR contains(lower(name), 'temp') THEN {_t(K.REASON_EXPERIMENT_NAME)} END,
     CASE WHEN contains(lower(relative_path), 'playground') THEN {_t(K.REASON_EXPERIMENT_PLAYGROUND)} END,
     {_t(K.REASON_EXPERIMENT_ADVICE)})
  WHEN 'markdown' THEN CASE WHEN upper(name) = 'README.MD' THEN {_t(K.REASON_README)}
     ELSE concat_ws('. ', {_t(K.REASON_MARKDOWN)},
                    CASE WHEN parent = '.' THEN {_t(K.REASON_MARKDOWN_ROOT)} END) END
  WHEN 'data' THEN concat_ws('. ', coalesce({_t(K.REASON_DATA_KIND, kind=_data_kind)}, {_t(K.REASON_DATA_DEFAULT)}),
     CASE WHEN parent = '.' THEN {_t(K.REASON_DATA_ROOT)} END)
  ELSE '' END"""

L["typed"] = (["classified", "repo_types"], """
SELECT c.*, t.repo_type FROM classified c JOIN repo_types t USING (repo_id)""")

L["cand"] = (["typed"], """
SELECT *, CASE WHEN depth > 1 THEN parts[1] END AS first_dir FROM typed
WHERE repo_type = 'python_dominant' OR (repo_type = 'mixed' AND extension = '.py')""")

L["cand_placed"] = (["cand"], """
SELECT *, coalesce(CASE category
    WHEN 'src' THEN first_dir = 'src' WHEN 'tests' THEN first_dir IN ('tests', 'test')
    WHEN 'configs' THEN first_dir IN ('configs', 'config') WHEN 'scripts' THEN first_dir = 'scripts'
    WHEN 'docs' THEN first_dir = 'docs' WHEN 'markdown' THEN first_dir IN ('docs', 'markdown')
    WHEN 'data' THEN first_dir = 'data' WHEN 'experiments' THEN first_dir IN ('experiments', 'playground')
    ELSE false END, false) AS correctly_placed
FROM cand""")

L["cand_target"] = (["cand_placed"], f"""
SELECT *, CASE category
    WHEN 'src' THEN 'src/' || relative_path
    WHEN 'tests' THEN 'tests/' || CASE WHEN depth > 1 THEN parent || '/' ELSE '' END
        || CASE WHEN starts_with(name, 'test_') OR ends_with(name, '_test.py') THEN name ELSE 'test_' || name END
    WHEN 'configs' THEN CASE WHEN name IN {_in(K.ROOT_CONFIG_TARGETS)} THEN name ELSE 'configs/' || name END
    WHEN 'scripts' THEN 'scripts/' || name
    WHEN 'docs' THEN 'docs/' || name
    WHEN 'markdown' THEN CASE WHEN upper(name) = 'README.MD' THEN 'README.md' ELSE 'docs/' || name END
    WHEN 'data' THEN 'data/' || name
    WHEN 'experiments' THEN 'experiments/' || name
    END AS target
FROM cand_placed WHERE NOT correctly_placed""")

L["phase1"] = (["cand_target"], f"""
SELECT repo_id, 1 AS phase, file_seq AS ord, 'move' AS action, relative_path AS source, target,
       CASE WHEN {_reason} = '' THEN {_t(K.REASON_FALLBACK, category='category')} ELSE {_reason} END || '.' AS reason,
       CASE WHEN len(imports) > 10 THEN 'high' WHEN is_executable THEN 'medium'
            WHEN category = 'configs' THEN 'medium' ELSE 'low' END AS risk,
       category, CASE WHEN parent = '.' THEN 'root' ELSE parent END AS current_location,
       NULL::VARCHAR AS suggestion, NULL::BIGINT AS total_count, NULL::VARCHAR AS examples, NULL::VARCHAR AS remaining,
       repo_type
FROM cand_target WHERE target IS NOT NULL AND target <> relative_path
UNION ALL
SELECT repo_id, 1, file_seq, 'flag', relative_path, NULL, {_q(K.TRASH_REASON)}, 'low', 'trash', NULL, NULL, NULL, NULL, NULL,
       repo_type
FROM cand_target WHERE category = 'trash'""")

L["dup_members"] = (["classified"], f"""
SELECT repo_id, lower(name) AS group_name, file_seq, relative_path, name FROM classified
WHERE name NOT IN {_in(K.DUPLICATE_EXEMPT)}""")

L["dup_all"] = (["dup_members", "repo_types"], f"""
SELECT g.*, t.repo_type, CASE WHEN t.repo_type = 'python_dominant' THEN 'python' ELSE 'nextjs' END AS profile
FROM (SELECT repo_id, group_name, count(*) AS total_count, arg_min(name, file_seq) AS first_name,
             arg_min(relative_path, file_seq) AS first_path, min(file_seq) AS first_seq,
             array_to_string(list(relative_path ORDER BY file_seq)[1:3], '|') AS examples
      FROM dup_members GROUP BY repo_id, group_name HAVING count(*) > 1) g
JOIN repo_types t USING (repo_id)""")

_nextjs = [p for n, p in K.PROFILES if n == "nextjs"][0]
L["dup_kept"] = (["dup_all"], f"""
SELECT *, profile = 'nextjs' AND ({' OR '.join(f"contains(lower(first_name), {_q(p)})" for p in _nextjs)}) AS suppressed
FROM dup_all""")

L["phase2"] = (["dup_kept"], f"""
SELECT repo_id, 2 AS phase, first_seq AS ord, 'flag' AS action, first_path AS source, NULL::VARCHAR AS target,
       {_t(K.DUPLICATE_REASON, n='CAST(total_count AS VARCHAR)', name='first_name')} AS reason,
       CASE WHEN lower(first_name) IN {_in(K.DUPLICATE_HIGH_RISK)} THEN 'high'
            WHEN lower(first_name) IN {_in(K.DUPLICATE_LOW_RISK)} THEN 'low'
            WHEN ends_with(lower(first_name), '.log') OR ends_with(lower(first_name), '.tmp') THEN 'low'
            ELSE 'medium' END AS risk,
       NULL::VARCHAR AS category, NULL::VARCHAR AS current_location, NULL::VARCHAR AS suggestion,
       CAST(total_count AS BIGINT) AS total_count, examples,
       CASE WHEN total_count > 3 THEN {_t(K.DUPLICATE_REMAINING, n='CAST(total_count - 3 AS VARCHAR)')} END AS remaining
FROM dup_kept WHERE NOT suppressed""")

L["phase3"] = (["typed"], f"""
SELECT repo_id, 3 AS phase, file_seq AS ord, 'flag' AS action, relative_path AS source, NULL::VARCHAR AS target,
       {_q(K.ROOT_FLAG_REASON)} AS reason, 'low' AS risk, NULL::VARCHAR AS category, NULL::VARCHAR AS current_location,
       {_q(K.ROOT_FLAG_SUGGESTION)} AS suggestion, NULL::BIGINT AS total_count, NULL::VARCHAR AS examples,
       NULL::VARCHAR AS remaining
FROM typed WHERE repo_type = 'python_dominant' AND depth = 1 AND extension = '.py'
  AND name NOT IN {_in(K.ROOT_FLAG_EXEMPT)}""")

_PCOLS = ("repo_id, CAST(phase AS BIGINT) AS phase, CAST(ord AS BIGINT) AS ord, action, source, target, reason, "
          "risk, category, current_location, suggestion, total_count, examples, remaining")
_PCOLS_PLAIN = ("repo_id, phase, ord, action, source, target, reason, risk, category, current_location, "
                "suggestion, total_count, examples, remaining")

L["gated1"] = (["phase1"], f"SELECT {_PCOLS_PLAIN} FROM phase1 WHERE action <> 'move' OR repo_type = 'python_dominant'")

L["props"] = (["gated1", "phase2", "phase3"], f"""
SELECT {_PCOLS_PLAIN} FROM gated1
UNION ALL SELECT {_PCOLS_PLAIN} FROM phase2
UNION ALL SELECT {_PCOLS_PLAIN} FROM phase3 p
  WHERE NOT EXISTS (SELECT 1 FROM gated1 m WHERE m.action = 'move' AND m.repo_id = p.repo_id AND m.source = p.source)""")

_o("J2_with_repo_type", ["typed"], "SELECT repo_id, relative_path, repo_type FROM typed")
_o("F6_candidates_by_repo_type", ["cand"], "SELECT repo_id, relative_path, category FROM cand")
_o("P11_correctly_placed", ["cand_placed"],
   "SELECT repo_id, relative_path, category, correctly_placed FROM cand_placed")
_o("P12_target_path", ["cand_target"], "SELECT repo_id, relative_path, category, target FROM cand_target")
_o("F3_drop_noop_moves", ["cand_target"],
   "SELECT repo_id, relative_path, category FROM cand_target WHERE target = relative_path")
_o("P13_move_risk", ["phase1"], "SELECT repo_id, source, risk FROM phase1 WHERE action = 'move'")
_o("P14_move_reason", ["phase1"], "SELECT repo_id, source, reason FROM phase1 WHERE action = 'move'")
_o("F8_unclassified_flags", ["phase1"], f"SELECT {_PCOLS} FROM phase1 WHERE action = 'flag'")
_o("F7_gate_moves", ["gated1"], f"SELECT {_PCOLS} FROM gated1")
_o("A8_duplicate_groups", ["phase2"], f"SELECT {_PCOLS} FROM phase2")
_o("A8_duplicate_members", ["dup_all", "dup_members"], """
SELECT m.repo_id, m.group_name, m.file_seq, m.relative_path FROM dup_members m
WHERE EXISTS (SELECT 1 FROM dup_all g WHERE g.repo_id = m.repo_id AND g.group_name = m.group_name)""")
L["all_dups"] = (["phase2", "dup_members"], """
SELECT p.repo_id, p.ord, m.file_seq, m.relative_path,
       row_number() OVER (PARTITION BY p.repo_id, p.ord ORDER BY m.file_seq) AS position
FROM phase2 p JOIN dup_members f ON f.repo_id = p.repo_id AND f.file_seq = p.ord
JOIN dup_members m ON m.repo_id = f.repo_id AND m.group_name = f.group_name""")
_o("A8_all_duplicates", ["all_dups"], "SELECT * FROM all_dups")
_o("P15_duplicate_risk", ["dup_all"], f"""
SELECT repo_id, group_name, first_name,
       CASE WHEN lower(first_name) IN {_in(K.DUPLICATE_HIGH_RISK)} THEN 'high'
            WHEN lower(first_name) IN {_in(K.DUPLICATE_LOW_RISK)} THEN 'low'
            WHEN ends_with(lower(first_name), '.log') OR ends_with(lower(first_name), '.tmp') THEN 'low'
            ELSE 'medium' END AS risk FROM dup_all""")
_o("F10_duplicate_exempt", ["classified"],
   f"SELECT repo_id, relative_path, name FROM classified WHERE name IN {_in(K.DUPLICATE_EXEMPT)}")
_o("F11_suppress_expected_duplicates", ["dup_kept"],
   "SELECT repo_id, group_name, first_name, profile FROM dup_kept WHERE suppressed")
_o("J3_with_profile", ["repo_types"], f"""
SELECT repo_id, repo_type, CASE WHEN repo_type = 'python_dominant' THEN 'python' ELSE 'nextjs' END AS profile,
       CASE WHEN repo_type = 'python_dominant' THEN '' ELSE {_q('|'.join(_nextjs))} END AS ignored_duplicate_patterns
FROM repo_types""")
_o("F9_root_python_flags", ["phase3"], f"SELECT {_PCOLS} FROM phase3")
_o("J4_suppress_redundant_flags", ["gated1", "phase3"], f"""
SELECT {_PCOLS} FROM (SELECT {_PCOLS_PLAIN} FROM gated1 UNION ALL SELECT {_PCOLS_PLAIN} FROM phase3) p
WHERE NOT (action = 'flag' AND contains(reason, {_q(K.ROOT_FLAG_REASON)})
           AND EXISTS (SELECT 1 FROM gated1 m WHERE m.action = 'move' AND m.repo_id = p.repo_id AND m.source = p.source))""")
_o("U1_all_proposals", ["props"], f"SELECT {_PCOLS} FROM props")
_o("F4_by_action", ["props"], f"SELECT {_PCOLS} FROM props WHERE action = 'flag'")
_o("F5_by_risk", ["props"], f"SELECT {_PCOLS} FROM props WHERE risk = 'high'")


# ---------------------------------------------------------------- reports
def _group_sql(source: str) -> str:
    src = f"lower({source})"
    fname = f"lower(string_split({source}, '/')[-1])"
    cfg = sorted({n.lower() for n in K.GROUP_CONFIG_NAMES})
    dep = sorted({n.lower() for n in K.GROUP_DEPENDENCY_NAMES})

    def ends(xs):
        return "(" + " OR ".join(f"ends_with({src}, {_q(x)})" for x in xs) + ")"
    return f"""CASE
  WHEN {fname} IN {_in(cfg)} THEN 'Configuration'
  WHEN {ends(K.GROUP_CONFIG_EXTENSIONS)} AND (contains({fname}, 'config') OR contains({fname}, 'settings')) THEN 'Configuration'
  WHEN {fname} IN {_in(dep)} THEN 'Dependencies'
  WHEN {ends(K.GROUP_LOG_SUFFIXES)} THEN 'Logs & Artifacts'
  WHEN {ends(K.GROUP_DOC_SUFFIXES)} THEN 'Documentation'
  WHEN contains({fname}, 'readme') OR contains({fname}, 'license') OR contains({fname}, 'changelog') THEN 'Documentation'
  WHEN contains({src}, 'script') THEN 'Scripts'
  WHEN contains({src}, 'test') THEN 'Tests'
  WHEN {ends(K.GROUP_CODE_SUFFIXES)} AND contains({src}, '/src/') THEN 'Source Code'
  ELSE 'Other' END"""


_rank = "CASE display_group " + " ".join(
    f"WHEN {_q(g)} THEN {i + 1}" for i, g in enumerate(K.GROUP_ORDER)) + " END"

L["props_grouped"] = (["props"], f"""
SELECT *, {_group_sql('source')} AS display_group FROM props""")

_o("P16_display_group", ["props_grouped"], f"""
SELECT repo_id, phase, CAST(ord AS BIGINT) AS ord, source, display_group, CAST({_rank} AS BIGINT) AS group_rank
FROM props_grouped""")
_o("W1_proposal_numbers", ["props_grouped"], f"""
SELECT repo_id, phase, CAST(ord AS BIGINT) AS ord, display_group,
       CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {_rank}, phase, ord) AS BIGINT) AS number
FROM props_grouped""")
ORACLE["U1_without_file_seq"] = layers("props_grouped", by_path=True) + f"""
SELECT {_PCOLS} FROM (SELECT * REPLACE (row_number() OVER (
  PARTITION BY repo_id ORDER BY {_rank}, phase, ord) AS ord) FROM props_grouped)"""
_o("A9_proposal_rollup", ["props_grouped"], """
SELECT repo_id, 'total' AS dimension, NULL::VARCHAR AS value, count(*) AS n FROM props_grouped GROUP BY repo_id
UNION ALL SELECT repo_id, 'action', action, count(*) FROM props_grouped GROUP BY ALL
UNION ALL SELECT repo_id, 'risk', risk, count(*) FROM props_grouped GROUP BY ALL
UNION ALL SELECT repo_id, 'display_group', display_group, count(*) FROM props_grouped GROUP BY ALL""")
_o("A10_proposals_document", ["props"], """
SELECT t.repo_id, t.total_proposals,
       CAST(to_json({'total_proposals': t.total_proposals, 'summary': {'by_action': a.m, 'by_risk': r.m}}) AS VARCHAR) AS document
FROM (SELECT repo_id, count(*) AS total_proposals FROM props GROUP BY repo_id) t
JOIN (SELECT repo_id, map_from_entries(list({'k': action, 'v': n} ORDER BY action)) AS m
      FROM (SELECT repo_id, action, count(*) AS n FROM props GROUP BY ALL) GROUP BY repo_id) a USING (repo_id)
JOIN (SELECT repo_id, map_from_entries(list({'k': risk, 'v': n} ORDER BY risk)) AS m
      FROM (SELECT repo_id, risk, count(*) AS n FROM props GROUP BY ALL) GROUP BY repo_id) r USING (repo_id)""")
_KEEP = "CASE WHEN {0} IS NOT NULL THEN '\"{0}\":' || to_json({0}) END"
_o("A10_document_chunks", ["props", "all_dups", "repo_list"], f"""
, counted AS (
  SELECT r.repo_id, count(p.repo_id) AS total,
         (SELECT coalesce(string_agg(to_json(action) || ':' || n, ',' ORDER BY action), '')
          FROM (SELECT action, count(*) AS n FROM props x WHERE x.repo_id = r.repo_id GROUP BY action)) AS by_action,
         (SELECT coalesce(string_agg(to_json(risk) || ':' || n, ',' ORDER BY risk), '')
          FROM (SELECT risk, count(*) AS n FROM props x WHERE x.repo_id = r.repo_id GROUP BY risk)) AS by_risk
  FROM repo_list r LEFT JOIN props p USING (repo_id) GROUP BY r.repo_id),
pieces AS (
  SELECT repo_id, 0 AS phase, 0 AS ord, 0 AS part, 0 AS position,
         '{{"total_proposals":' || total || ',"proposals":[' AS piece FROM counted
  UNION ALL
  SELECT repo_id, phase, ord, 0, 0,
         CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY phase, ord) > 1 THEN ',' ELSE '' END
         || '{{"action":' || to_json(action) || ',"source":' || to_json(source) || ',"target":'
         || coalesce(to_json(target)::VARCHAR, 'null') || ',"reason":' || to_json(reason) || ',"risk":' || to_json(risk)
         || ',"details":{{' || concat_ws(',', {", ".join(_KEEP.format(c) for c in (
             "category", "current_location", "suggestion", "total_count"))},
              CASE WHEN examples IS NOT NULL THEN '"examples":' || to_json(string_split(examples, '|')) END)
         || CASE WHEN phase = 2 THEN ',"all_duplicates":[' ELSE '}}}}' END FROM props
  UNION ALL
  SELECT repo_id, 2, ord, 1, position, CASE WHEN position > 1 THEN ',' ELSE '' END || to_json(relative_path)
  FROM all_dups
  UNION ALL
  SELECT repo_id, phase, ord, 2, 0, ']' || CASE WHEN remaining IS NOT NULL
         THEN ',"remaining":' || to_json(remaining) ELSE '' END || '}}}}' FROM props WHERE phase = 2
  UNION ALL
  SELECT repo_id, 9, 0, 0, 0, '],"summary":{{"by_action":{{' || by_action || '}},"by_risk":{{' || by_risk || '}}}}}}'
  FROM counted),
placed AS (
  SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY repo_id ORDER BY phase, ord, part, position
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1048576 AS chunk_no FROM pieces)
SELECT repo_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(sum(strlen(piece)) AS BIGINT) AS n_bytes,
       string_agg(piece, '' ORDER BY phase, ord, part, position) AS text
FROM placed GROUP BY ALL""")
_o("S3_write_proposals", ["props"], """
SELECT repo_id, phase, CAST(ord AS BIGINT) AS ord,
  CAST(to_json({'action': action, 'source': source, 'target': target, 'reason': reason, 'risk': risk,
           'details': {'category': category, 'current_location': current_location, 'suggestion': suggestion,
                       'total_count': total_count,
                       'examples': CASE WHEN examples IS NULL THEN NULL::VARCHAR[] ELSE string_split(examples, '|') END,
                       'remaining': remaining}}) AS VARCHAR) AS record
FROM props""")
_o("P19_proposal_text", ["props"], f"""
SELECT repo_id, phase, CAST(ord AS BIGINT) AS ord,
  concat_ws(chr(10), {_t(K.PROPOSAL_HEAD, ACTION='upper(action)', source='source')},
            CASE WHEN target IS NOT NULL THEN {_t(K.PROPOSAL_TARGET, target='target')} END,
            {_t(K.PROPOSAL_REASON, reason='reason')}, {_t(K.PROPOSAL_RISK, RISK='upper(risk)')},
            CASE WHEN examples IS NOT NULL THEN concat_ws(chr(10), {_t(K.PROPOSAL_EXAMPLES)},
                   array_to_string(list_transform(string_split(examples, '|'),
                                                  lambda e: {_t(K.PROPOSAL_EXAMPLE, path='e')}), chr(10)),
                   CASE WHEN remaining IS NOT NULL THEN {_t(K.PROPOSAL_REMAINING, remaining='remaining')} END)
                 ELSE nullif(concat_ws(chr(10),
                   CASE WHEN category IS NOT NULL THEN {_t(K.PROPOSAL_DETAIL, key="'category'", value='category')} END,
                   CASE WHEN current_location IS NOT NULL THEN {_t(K.PROPOSAL_DETAIL, key="'current_location'", value='current_location')} END,
                   CASE WHEN suggestion IS NOT NULL THEN {_t(K.PROPOSAL_DETAIL, key="'suggestion'", value='suggestion')} END), '') END) AS text
FROM props""")


# ---------------------------------------------------------------- imports
def _parent_sql(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE '.' END"


_itext = """CASE WHEN is_relative AND module <> '' THEN 'from ' || repeat('.', level) || module || ' import ' || array_to_string(names, ', ')
  WHEN is_relative THEN 'from ' || repeat('.', level) || ' import ' || array_to_string(names, ', ')
  WHEN len(names) > 0 THEN 'from ' || module || ' import ' || array_to_string(names, ', ')
  ELSE 'import ' || module END"""

L["ostmts"] = (["stmt_rows"], """
SELECT *, row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY line_no, part_no) - 1 AS stmt_no
FROM stmt_rows""")
L["moves"] = (["props"], "SELECT * FROM props WHERE action = 'move'")
L["mst"] = (["moves", "ostmts"], f"""
SELECT m.repo_id, m.ord AS move_ord, m.source, m.target, s.stmt_no, s.module, s.is_relative, s.level,
       s.line_no AS line_number, s.names, {_parent_sql('m.source')} AS src_dir, {_parent_sql('m.target')} AS tgt_dir
FROM moves m JOIN ostmts s ON s.repo_id = m.repo_id AND s.relative_path = m.source""")
L["w_rel"] = (["mst", "inv", "moves"], f"""
SELECT x.*, 'relative' AS kind,
  {_t(K.IMPORT_RELATIVE, source_dir='src_dir', target_dir='tgt_dir')} AS reason,
  CASE WHEN module <> '' AND (EXISTS (SELECT 1 FROM inv r WHERE r.repo_id = x.repo_id AND r.relative_path = x.cand)
                              OR EXISTS (SELECT 1 FROM moves o WHERE o.repo_id = x.repo_id AND o.source = x.cand))
       THEN split_part(module, '.', 1) || '.py' ELSE '' END AS affected
FROM (SELECT *, CASE WHEN src_dir = '.' THEN '' ELSE src_dir || '/' END || split_part(module, '.', 1) || '.py' AS cand
      FROM mst WHERE is_relative AND src_dir <> tgt_dir) x""")
L["w_sib"] = (["mst", "inv", "moves"], f"""
SELECT y.*, 'sibling' AS kind,
  CASE WHEN o_target IS NULL THEN {_t(K.IMPORT_SIBLING_STAYS, module='modname', source_dir='src_dir')}
       ELSE {_t(K.IMPORT_SIBLING_MOVES, module='modname', file="modname || '.py'", other_dir=_parent_sql('o_target'))} END AS reason,
  cand AS affected
FROM (SELECT x.*, o.target AS o_target
      FROM (SELECT *, split_part(module, '.', 1) AS modname,
                   CASE WHEN src_dir = '.' THEN '' ELSE src_dir || '/' END || split_part(module, '.', 1) || '.py' AS cand
            FROM mst WHERE NOT is_relative AND src_dir <> tgt_dir) x
      LEFT JOIN moves o ON o.repo_id = x.repo_id AND o.source = x.cand
      WHERE EXISTS (SELECT 1 FROM inv r WHERE r.repo_id = x.repo_id AND r.relative_path = x.cand)) y
WHERE o_target IS NULL OR {_parent_sql('o_target')} <> tgt_dir""")
_WCOLS = f"""repo_id, CAST(move_ord AS BIGINT) AS move_ord, source, CAST(stmt_no AS BIGINT) AS stmt_no, kind,
  CAST(line_number AS BIGINT) AS line_number, {_itext} AS import_text, reason, affected"""
L["warnings"] = (["w_rel", "w_sib"], f"""
SELECT {_WCOLS} FROM w_rel UNION ALL SELECT {_WCOLS} FROM w_sib""")

_o("J5_relative_import_risk", ["w_rel"], f"SELECT {_WCOLS} FROM w_rel")
_o("J6_sibling_import_risk", ["w_sib"], f"SELECT {_WCOLS} FROM w_sib")
_o("J7_import_warnings", ["warnings"], "SELECT * FROM warnings")
_o("J12_affected_existing", ["mst", "inv", "moves"], """
SELECT repo_id, CAST(move_ord AS BIGINT) AS move_ord, CAST(stmt_no AS BIGINT) AS stmt_no, cand AS candidate,
  EXISTS (SELECT 1 FROM inv r WHERE r.repo_id = x.repo_id AND r.relative_path = x.cand) AS on_disk,
  EXISTS (SELECT 1 FROM moves o WHERE o.repo_id = x.repo_id AND o.source = x.cand) AS is_moving
FROM (SELECT *, CASE WHEN src_dir = '.' THEN '' ELSE src_dir || '/' END || split_part(module, '.', 1) || '.py' AS cand
      FROM mst WHERE is_relative AND src_dir <> tgt_dir AND module <> '') x""")
_o("P17_import_text", ["ostmts"], f"""
SELECT repo_id, relative_path, CAST(stmt_no AS BIGINT) AS stmt_no, {_itext} AS import_text FROM ostmts""")
_o("P18_import_warning_text", ["warnings"], f"""
SELECT repo_id, move_ord, stmt_no, source,
  concat_ws(chr(10), {_t(K.WARNING_HEAD, source='source')},
            {_t(K.WARNING_LINE, line='CAST(line_number AS VARCHAR)', statement='import_text')},
            {_t(K.WARNING_RISK, reason='reason')},
            CASE WHEN affected <> '' THEN {_t(K.WARNING_AFFECTED, files='affected')} END) AS text
FROM warnings""")
_o("A18_warning_counts", ["repo_list", "warnings"], """
SELECT r.repo_id, CAST(coalesce(w.n, 0) AS BIGINT) AS import_warnings_count
FROM repo_list r LEFT JOIN (SELECT repo_id, count(*) AS n FROM warnings GROUP BY repo_id) w USING (repo_id)""")


# ---------------------------------------------------------------- git
L["unc"] = (["git_status", "repos"], """
SELECT s.repo_id, s.line_no, substring(s.line, 1, 2) AS status, trim(substring(s.line, 4)) AS path
FROM git_status s JOIN repos r ON r.repo_id = s.repo_id AND r.is_git
WHERE length(s.line) >= 4 AND trim(substring(s.line, 1, 2)) <> ''""")
L["tmoves"] = (["moves", "repos", "git_tracked"], """
SELECT m.* FROM moves m
WHERE EXISTS (SELECT 1 FROM repos r WHERE r.repo_id = m.repo_id AND r.is_git)
  AND EXISTS (SELECT 1 FROM git_tracked g WHERE g.repo_id = m.repo_id AND g.relative_path = m.source)""")
_o("P20_parse_git_status", ["unc"], "SELECT repo_id, line_no, status, path FROM unc")
_o("J8_tracked_moves", ["tmoves"], "SELECT repo_id, CAST(ord AS BIGINT) AS ord, source, target FROM tmoves")
_o("A15_git_warnings", ["unc", "tmoves"], f"""
SELECT repo_id, 'uncommitted' AS warning_type, {_t(K.GIT_UNCOMMITTED)} AS message,
       array_to_string(list(path ORDER BY line_no)[1:5], '|') AS details, count(*) AS total
FROM unc GROUP BY repo_id
UNION ALL
SELECT repo_id, 'tracked_files', {_t(K.GIT_TRACKED, n='CAST(count(*) AS VARCHAR)')},
       array_to_string(list(source ORDER BY phase, ord)[1:5], '|'), count(*)
FROM tmoves GROUP BY repo_id""")

# ---------------------------------------------------------------- confidence
L["conf_in"] = (["repo_types", "classified", "moves", "warnings"], """
SELECT t.repo_id, t.repo_type,
  coalesce((SELECT count(*) FILTER (WHERE has_tests) FROM classified c WHERE c.repo_id = t.repo_id), 0) > 0 AS has_tests,
  (SELECT count(*) FROM moves m WHERE m.repo_id = t.repo_id) AS mv,
  (SELECT count(*) FROM moves m WHERE m.repo_id = t.repo_id AND m.risk = 'high') AS hi,
  (SELECT count(*) FROM moves m WHERE m.repo_id = t.repo_id AND m.risk = 'medium') AS me,
  (SELECT count(*) FROM moves m WHERE m.repo_id = t.repo_id AND m.risk = 'low') AS lo,
  (SELECT count(*) FROM warnings w WHERE w.repo_id = t.repo_id) AS w,
  true AS is_dry_run
FROM repo_types t""")
L["conf"] = (["conf_in"], """
SELECT *,
  100 - (CASE WHEN repo_type = 'non_python' THEN 30 ELSE 0 END) - 20 * least(hi, 3)
      - (CASE WHEN me > 5 THEN 15 ELSE 0 END) - 10 * least(w, 3)
      - (CASE WHEN NOT has_tests AND mv > 0 THEN 10 ELSE 0 END) + (CASE WHEN is_dry_run THEN 5 ELSE 0 END)
      - (CASE WHEN mv > 20 THEN 15 ELSE 0 END) AS score
FROM conf_in""")
L["conf2"] = (["conf"], f"""
SELECT *, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
  concat_ws('|',
    CASE WHEN repo_type = 'python_dominant' THEN {_t(K.FACTOR_PYTHON)}
         WHEN repo_type <> 'non_python' THEN {_t(K.FACTOR_OTHER_TYPE, repo_type='repo_type')} END,
    CASE WHEN has_tests THEN {_t(K.FACTOR_TESTS)} END,
    CASE WHEN mv = 0 THEN {_t(K.FACTOR_NO_MOVES)}
         WHEN mv <= 5 THEN {_t(K.FACTOR_FEW_MOVES, n='CAST(mv AS VARCHAR)')} END,
    CASE WHEN lo > 0 AND hi = 0 AND me = 0 THEN {_t(K.FACTOR_ALL_LOW, n='CAST(lo AS VARCHAR)')} END,
    CASE WHEN w = 0 AND mv > 0 THEN {_t(K.FACTOR_NO_WARNINGS)} END,
    CASE WHEN is_dry_run THEN {_t(K.FACTOR_DRY_RUN)} END) AS positive_factors,
  concat_ws('|',
    CASE WHEN repo_type = 'non_python' THEN {_t(K.FACTOR_NON_PYTHON)} END,
    CASE WHEN NOT has_tests AND mv > 0 THEN {_t(K.FACTOR_NO_TESTS)} END,
    CASE WHEN mv > 15 THEN {_t(K.FACTOR_MANY_MOVES, n='CAST(mv AS VARCHAR)')}
         WHEN mv > 5 THEN {_t(K.FACTOR_SOME_MOVES, n='CAST(mv AS VARCHAR)')} END,
    CASE WHEN hi > 0 THEN {_t(K.FACTOR_HIGH, n='CAST(hi AS VARCHAR)')} END,
    CASE WHEN me > 0 THEN {_t(K.FACTOR_MEDIUM, n='CAST(me AS VARCHAR)')} END,
    CASE WHEN w > 0 THEN {_t(K.FACTOR_WARNINGS, n='CAST(w AS VARCHAR)')} END) AS risk_factors
FROM conf""")
_interp = "CASE confidence_level " + " ".join(f"WHEN {_q(l)} THEN {_q(x)}" for l, x in K.INTERPRETATIONS) + " END"
_o("A13_confidence", ["conf2"], """
SELECT repo_id, confidence_level, CAST(score AS BIGINT) AS score, CAST(mv AS BIGINT) AS move_count,
  CAST(hi AS BIGINT) AS high_risk_count, CAST(me AS BIGINT) AS medium_risk_count, CAST(lo AS BIGINT) AS low_risk_count,
  CAST(w AS BIGINT) AS import_warnings_count, has_tests, is_dry_run FROM conf2""")
_o("A14_confidence_factors", ["conf2"], "SELECT repo_id, positive_factors, risk_factors FROM conf2")
_o("P21_interpretation", ["conf2"], f"SELECT repo_id, confidence_level, {_interp} AS interpretation FROM conf2")


# ---------------------------------------------------------------- preview
L["affected"] = (["props"], "SELECT DISTINCT repo_id, source AS path FROM props WHERE action IN ('move', 'flag')")
L["after"] = (["affected", "moves"], """
SELECT a.repo_id, a.path AS source, coalesce(m.target, a.path) AS path
FROM affected a LEFT JOIN moves m ON m.repo_id = a.repo_id AND m.source = a.path""")
L["cut"] = (["affected", "after"], """
SELECT repo_id, side, CAST(pos AS BIGINT) AS pos, path, affected_total FROM (
  SELECT repo_id, side, path, row_number() OVER (PARTITION BY repo_id, side ORDER BY string_split(path, '/'), tie) AS pos,
         count(*) OVER (PARTITION BY repo_id, side) AS n
  FROM (SELECT repo_id, 'before' AS side, path, path AS tie FROM affected
        UNION ALL SELECT repo_id, 'after', path, source FROM after)) x
JOIN (SELECT repo_id, count(*) AS affected_total FROM affected GROUP BY repo_id) t USING (repo_id)
WHERE pos <= 50""")
L["paths_all"] = (["affected", "after"], """
SELECT repo_id, 'before' AS side, path FROM affected UNION SELECT repo_id, 'after', path FROM after""")
# tree nodes: prefixes of the paths; a node is a file iff it is one of the paths.
# T1, T2 and W4 draw all affected paths, T3 the cut ones.
for _all, _paths in (("", "cut"), ("_all", "paths_all")):
    L[f"tnodes0{_all}"] = ([_paths], f"""
SELECT DISTINCT repo_id, side, array_to_string(string_split(path, '/')[1:k], '/') AS node, k AS depth,
       string_split(path, '/')[k] AS name,
       array_to_string(string_split(path, '/')[1:k - 1], '/') AS parent
FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM {_paths})""")
    L[f"tnodes{_all}"] = ([f"tnodes0{_all}", _paths], f"""
SELECT n.*, EXISTS (SELECT 1 FROM {_paths} c WHERE c.repo_id = n.repo_id AND c.side = n.side AND c.path = n.node) AS is_file
FROM tnodes0{_all} n
WHERE NOT EXISTS (SELECT 1 FROM {_paths} c WHERE c.repo_id = n.repo_id AND c.side = n.side
                  AND starts_with(n.node, c.path || '/'))""")
    L[f"tlines0{_all}"] = ([f"tnodes{_all}"], f"""
SELECT *, row_number() OVER (PARTITION BY repo_id, side, parent ORDER BY is_file DESC, name DESC) = 1 AS is_last
FROM tnodes{_all}""")
    L[f"tlines{_all}"] = ([f"tlines0{_all}"], f"""
SELECT t.*,
  coalesce((SELECT string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth)
            FROM tlines0{_all} a WHERE a.repo_id = t.repo_id AND a.side = t.side AND a.depth < t.depth
              AND starts_with(t.node, a.node || '/')), '')
  || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_file THEN '' ELSE '/' END AS text,
  row_number() OVER (PARTITION BY repo_id, side ORDER BY
     list_transform(string_split(node, '/'), lambda x, i: {{'f': i = depth AND is_file, 'n': x}})) AS line_no
FROM tlines0{_all} t""")

_o("U2_affected_files", ["affected"], "SELECT repo_id, path FROM affected")
_o("J9_after_state", ["after"], "SELECT repo_id, source, path FROM after")
_o("L2_limit_affected", ["cut"], "SELECT * FROM cut")
_o("T1_tree_nodes", ["tnodes_all"], "SELECT repo_id, side, node, parent, CAST(depth AS BIGINT) AS depth, is_file FROM tnodes_all")
_o("T2_tree_lines", ["tlines_all"], "SELECT repo_id, side, CAST(line_no AS BIGINT) AS line_no, node, is_last, text FROM tlines_all")
_o("W4_last_sibling", ["tlines0_all"], "SELECT repo_id, side, node, is_last FROM tlines0_all")
ORACLE["T3_tree_diff"] = layers("tlines", "moves") + f"""
, heads AS (SELECT DISTINCT repo_id, side, affected_total FROM cut WHERE repo_id IN (SELECT repo_id FROM moves))
SELECT repo_id, side, CAST(0 AS BIGINT) AS line_no, '.' AS text FROM heads
UNION ALL SELECT repo_id, side, CAST(line_no AS BIGINT), text FROM tlines WHERE repo_id IN (SELECT repo_id FROM moves)
UNION ALL SELECT repo_id, side, CAST(1000000000 AS BIGINT), {_t(K.TREE_NOTE, shown="'50'", total='CAST(affected_total AS VARCHAR)')}
FROM heads WHERE affected_total > 50"""
L["newdirs"] = (["moves"], """
SELECT DISTINCT repo_id, array_to_string(string_split(target, '/')[1:k], '/') AS directory
FROM (SELECT repo_id, target, unnest(range(1, len(string_split(target, '/')))) AS k FROM moves)""")
_o("A12_new_directories", ["newdirs"], "SELECT * FROM newdirs")
_o("A11_impact_summary", ["repo_list", "props", "newdirs"], """
SELECT r.repo_id,
  CAST((SELECT count(*) FROM props p WHERE p.repo_id = r.repo_id AND action = 'move') AS BIGINT) AS total_moves,
  CAST((SELECT count(*) FROM props p WHERE p.repo_id = r.repo_id AND action = 'flag') AS BIGINT) AS total_flags,
  CAST((SELECT count(*) FROM props p WHERE p.repo_id = r.repo_id AND action = 'move' AND risk = 'high') AS BIGINT) AS high,
  CAST((SELECT count(*) FROM props p WHERE p.repo_id = r.repo_id AND action = 'move' AND risk = 'medium') AS BIGINT) AS medium,
  CAST((SELECT count(*) FROM props p WHERE p.repo_id = r.repo_id AND action = 'move' AND risk = 'low') AS BIGINT) AS low,
  CAST((SELECT count(*) FROM props p WHERE p.repo_id = r.repo_id AND action = 'flag' AND contains(reason, 'Duplicate filename:')) AS BIGINT) AS duplicate_groups,
  CAST((SELECT count(*) FROM newdirs d WHERE d.repo_id = r.repo_id) AS BIGINT) AS new_directories
FROM repo_list r""")
_o("L3_first_k_lists", ["newdirs"], f"""
SELECT repo_id, CAST(count(*) AS BIGINT) AS new_directories,
  array_to_string(list(directory ORDER BY directory)[1:5], ', ')
  || CASE WHEN count(*) > 5 THEN {_t(K.NEW_DIRS_MORE, n='CAST(count(*) - 5 AS VARCHAR)')} ELSE '' END AS preview
FROM newdirs GROUP BY repo_id""")


# ---------------------------------------------------------------- apply
L["approved"] = (["moves", "decisions"], """
SELECT m.*, coalesce(lower(trim(d.decision)), 'n') AS decision,
       coalesce(lower(trim(d.decision)), 'n') IN ('y', 'yes') AS approved
FROM moves m LEFT JOIN decisions d ON d.repo_id = m.repo_id AND d.source = m.source""")
L["inv_dirs"] = (["inv"], """
SELECT DISTINCT repo_id, array_to_string(string_split(relative_path, '/')[1:k], '/') AS path
FROM (SELECT repo_id, relative_path, unnest(range(1, len(string_split(relative_path, '/')))) AS k FROM inv)""")
L["dry"] = (["approved", "inv", "inv_dirs"], f"""
SELECT repo_id, ord, action, source, target, err IS NULL AS success, false AS skipped,
  CASE WHEN err IS NULL THEN {_t(K.MSG_DRY_RUN_MOVE, source='source', target='target')} ELSE {_t(K.MSG_VALIDATION_FAILED, error='err')} END AS message
FROM (
 SELECT a.*, CASE
   WHEN source IS NULL THEN {_t(K.MSG_NO_SOURCE)}
   WHEN target IS NULL THEN {_t(K.MSG_NO_TARGET)}
   WHEN NOT EXISTS (SELECT 1 FROM inv i WHERE i.repo_id = a.repo_id AND i.relative_path = a.source)
    AND NOT EXISTS (SELECT 1 FROM inv_dirs d WHERE d.repo_id = a.repo_id AND d.path = a.source)
     THEN {_t(K.MSG_SOURCE_MISSING, path="repo_id || '/' || source")}
   WHEN NOT EXISTS (SELECT 1 FROM inv i WHERE i.repo_id = a.repo_id AND i.relative_path = a.source)
     THEN {_t(K.MSG_SOURCE_NOT_FILE, path="repo_id || '/' || source")}
   WHEN EXISTS (SELECT 1 FROM inv i WHERE i.repo_id = a.repo_id AND i.relative_path = a.target)
     OR EXISTS (SELECT 1 FROM inv_dirs d WHERE d.repo_id = a.repo_id AND d.path = a.target)
     THEN {_t(K.MSG_TARGET_EXISTS, path="repo_id || '/' || target")}
   WHEN contains(target, '/')
     AND EXISTS (SELECT 1 FROM inv i WHERE i.repo_id = a.repo_id AND i.relative_path = {_parent_sql('a.target')})
     AND NOT EXISTS (SELECT 1 FROM inv_dirs d WHERE d.repo_id = a.repo_id AND d.path = {_parent_sql('a.target')})
     THEN {_t(K.MSG_PARENT_NOT_DIR, path="repo_id || '/' || " + _parent_sql('a.target'))}
   END AS err
 FROM approved a WHERE approved) x""")
_RCOLS = "repo_id, CAST(ord AS BIGINT) AS ord, action, source, target, success, skipped, message"
_o("J11_with_decisions", ["approved"],
   "SELECT repo_id, CAST(ord AS BIGINT) AS ord, source, decision, approved FROM approved")
_o("J10_validate_moves", ["dry"], f"SELECT {_RCOLS} FROM dry")
_o("P22_result_message", ["dry", "props"], f"""
SELECT {_RCOLS} FROM dry
UNION ALL SELECT repo_id, CAST(ord AS BIGINT), action, source, target, false, true,
  {_t(K.MSG_UNSUPPORTED, action='action')} FROM props WHERE action <> 'move'""")
_o("A16_execution_summary", ["dry", "repo_list"], """
SELECT repo_id, count(action) AS total, count(*) FILTER (WHERE success) AS successful,
       count(*) FILTER (WHERE NOT success AND NOT skipped) AS failed, count(*) FILTER (WHERE skipped) AS skipped
FROM repo_list LEFT JOIN dry USING (repo_id) GROUP BY repo_id""")

# ---------------------------------------------------------------- history
L["undo"] = (["history"], """
SELECT * FROM history WHERE upper(action) = 'MOVE' AND success IS TRUE AND skipped IS NOT TRUE""")
L["undo_n"] = (["undo"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) AS undo_rank FROM undo)
WHERE undo_rank <= 10""")
L["hf_dirs"] = (["history_files"], """
SELECT DISTINCT repo_id, array_to_string(string_split(relative_path, '/')[1:k], '/') AS path
FROM (SELECT repo_id, relative_path, unnest(range(1, len(string_split(relative_path, '/')))) AS k FROM history_files)""")


def _rb_dry(src: str) -> str:
    return f"""
SELECT * EXCLUDE (success), ok_t AND ok_s AS success,
  CASE WHEN NOT ok_t THEN {_t(K.MSG_ROLLBACK_TARGET_MISSING, path="repo_id || '/' || target")}
       WHEN NOT ok_s THEN {_t(K.MSG_ROLLBACK_SOURCE_EXISTS, path="repo_id || '/' || source")}
       ELSE {_t(K.MSG_DRY_RUN_ROLLBACK, source='target', target='source')} END AS message
FROM (SELECT u.*,
  EXISTS (SELECT 1 FROM history_files f WHERE f.repo_id = u.repo_id AND f.relative_path = u.target)
   OR EXISTS (SELECT 1 FROM hf_dirs d WHERE d.repo_id = u.repo_id AND d.path = u.target) AS ok_t,
  NOT (EXISTS (SELECT 1 FROM history_files f WHERE f.repo_id = u.repo_id AND f.relative_path = u.source)
   OR EXISTS (SELECT 1 FROM hf_dirs d WHERE d.repo_id = u.repo_id AND d.path = u.source)) AS ok_s
 FROM {src} u)"""


L["rb_all"] = (["undo", "history_files", "hf_dirs"], _rb_dry("undo"))
L["rb_n"] = (["undo_n", "history_files", "hf_dirs"], _rb_dry("undo_n"))


def _cut(src: str) -> str:
    return f"""
SELECT repo_id, CAST(seq AS BIGINT) AS undone_seq, target AS source, source AS target, success, message, 'high' AS risk
FROM {src} r WHERE seq >= coalesce((SELECT max(seq) FROM {src} x WHERE x.repo_id = r.repo_id AND NOT x.success), -1)"""


_o("S4_append_history", ["history"], """
SELECT * FROM history UNION ALL SELECT * FROM history WHERE action = 'ROLLBACK'""")
_o("S5_read_history", ["history"], "SELECT * FROM history")
_o("F12_undoable", ["undo"], "SELECT repo_id, seq, action, source, target FROM undo")
_o("W2_last_moves", ["undo_n"], "SELECT repo_id, seq, CAST(undo_rank AS BIGINT) AS undo_rank, source, target FROM undo_n")
_o("W3_fail_fast", ["rb_all"], _cut("rb_all"))
_o("G2_rollback_dry_run", ["rb_n"], _cut("rb_n"))
_o("W5_recent_history", ["history"], """
SELECT repo_id, seq, CAST(position AS BIGINT) AS position, action, source, total_entries FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) AS position,
         count(*) OVER (PARTITION BY repo_id) AS total_entries FROM history) WHERE position <= 20""")
ORACLE["A17_rollback_summary"] = layers("rb_n") + f"""
SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE success) AS successful,
       count(*) FILTER (WHERE NOT success) AS failed FROM ({_cut('rb_n')}) GROUP BY repo_id"""

_o("S1_scan_trees", ["kept"], """
SELECT repo_id, relative_path, CAST(strlen(content) AS BIGINT) AS size,
       CASE WHEN ends_with(relative_path, '.py') THEN content END AS content FROM kept""")
