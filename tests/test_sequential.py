"""G1 / G2 against a whole-repository sequential replay in plain Python.

The Spark jobs replay per connected component of moves; here every
repository is replayed in one pass, which is the reference's semantics.
"""

import random


from treeline.operators import history as HI
from treeline.operators import moves as MV


def _anc(p):
    parts = p.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts))]


def brute_apply(disk, moves, left=None):
    """Outcome of each move; ``left`` (a list) gets the files at the end."""
    files, dirs = set(disk), {a for f in disk for a in _anc(f)}
    out = {}
    for node, s, t in sorted(moves):
        parent = "/".join(t.split("/")[:-1]) or None
        if s not in files and s not in dirs:
            out[node] = (False, f"Validation failed: Source file does not exist: r/{s}")
        elif s not in files:
            out[node] = (False, f"Validation failed: Source is not a file: r/{s}")
        elif t in files or t in dirs:
            out[node] = (False, f"Validation failed: Target already exists (conflict): r/{t}")
        elif parent and parent in files and parent not in dirs:
            out[node] = (False, f"Validation failed: Target parent exists but is not a directory: r/{parent}")
        elif any(a in files for a in _anc(t)):
            a = next(a for a in _anc(t) if a in files)
            out[node] = (False, f"Failed to execute: Not a directory: r/{a}")
        else:
            files.discard(s)
            files.add(t)
            dirs.update(_anc(t))
            out[node] = (True, f"Moved {s} -> {t}")
    if left is not None:
        left += sorted(files)
    return out


def brute_rollback(disk, entries, n, left=None):
    files, dirs = set(disk), {a for f in disk for a in _anc(f)}
    chosen = sorted(entries, reverse=True)[:n]
    out = {}
    for seq, s, t in chosen:
        if t not in files and t not in dirs:
            out[seq] = (False, f"Rollback validation failed: Target file does not exist: r/{t}")
            break
        if s in files or s in dirs:
            out[seq] = (False, f"Rollback validation failed: Source location already exists (conflict): r/{s}")
            break
        if any(a in files for a in _anc(s)):
            a = next(a for a in _anc(s) if a in files)
            out[seq] = (False, f"Rollback failed: Not a directory: r/{a}")
            break
        if t in files:
            files.discard(t)
            files.add(s)
        else:                       # a directory moves as one path (contents not followed)
            dirs.discard(t)
            dirs.add(s)
        dirs.update(_anc(s))
        out[seq] = (True, f"Rolled back {t} -> {s}")
    if left is not None:
        left += sorted(files)
    return out


NAMES = ["a", "b", "c.py", "d.py", "src", "tests"]


def _path(rng, depth=3):
    return "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, depth)))


def _disk(spark, disk):
    return spark.createDataFrame([("r", p) for p in sorted(disk)], "repo_id string, relative_path string")


def test_apply_moves_matches_sequential_replay(spark):
    rng = random.Random(11)
    for round_no in range(4):
        disk = {_path(rng, 3 + round_no % 2) for _ in range(30)}
        # keep the disk a valid tree: no path is both a file and a directory
        disk = {p for p in disk if not any(q.startswith(p + "/") for q in disk)}
        sources = rng.sample(sorted(disk), min(12, len(disk)))
        fan = _path(rng)        # a shared target, so simple same-target groups occur too
        moves = [(i, s, rng.choice([_path(rng, 4), rng.choice(sources), fan, fan]))
                 for i, s in enumerate(sources)]
        moves = [m for m in moves if m[1] != m[2]]
        df = spark.createDataFrame(
            [("r", 1, i, "move", s, t, "low", True) for i, s, t in moves],
            "repo_id string, phase int, ord bigint, action string, source string, target string, "
            "risk string, approved boolean")
        got = {r["ord"]: (r["success"], r["message"])
               for r in MV.apply_moves(df, _disk(spark, disk)).collect()}
        assert got == brute_apply(disk, moves)


def test_repeated_sources_and_chains_leave_the_right_tree(spark):
    """Moves that share a source, or move a file on, against the sequential replay."""
    rng = random.Random(21)
    for _ in range(2):
        disk = {_path(rng, 3) for _ in range(12)}
        disk = {p for p in disk if not any(q.startswith(p + "/") for q in disk)}
        places = sorted(disk) + [_path(rng, 2) for _ in range(4)]
        moves = [(i, rng.choice(places), rng.choice(places + [_path(rng, 3)])) for i in range(25)]
        moves = [m for m in moves if m[1] != m[2]] + [(90, "z0.py", "z1.py"), (91, "z1.py", "z2.py"),
                                                      (92, "z0.py", "z3.py")]
        disk |= {"z0.py"}
        df = spark.createDataFrame(
            [("r", 1, i, "move", s, t, "low", True) for i, s, t in moves],
            "repo_id string, phase int, ord bigint, action string, source string, target string, "
            "risk string, approved boolean")
        res = MV.apply_moves(df, _disk(spark, disk)).checkpoint(eager=True)
        left = []
        want = brute_apply(disk, moves, left)
        assert {r["ord"]: (r["success"], r["message"]) for r in res.collect()} == want
        new = MV.new_inventory(_disk(spark, disk), res)
        assert sorted(r.relative_path for r in new.collect()) == left and "z2.py" in left


def test_rollback_matches_sequential_replay(spark):
    rng = random.Random(5)
    for n in (3, 40):
        disk = {_path(rng) for _ in range(25)}
        disk = {p for p in disk if not any(q.startswith(p + "/") for q in disk)}
        entries = [(seq, _path(rng), _path(rng)) for seq in range(1, 40)]
        entries = [e for e in entries if e[1] != e[2]]
        hist = spark.createDataFrame(
            [("r", seq, "MOVE", s, t, True, False) for seq, s, t in entries],
            "repo_id string, seq bigint, action string, source string, target string, success boolean, "
            "skipped boolean")
        res = HI.rollback(hist, _disk(spark, disk), n).checkpoint(eager=True)
        left = []
        got = {r["undone_seq"]: (r["success"], r["message"]) for r in res.collect()}
        assert got == brute_rollback(disk, entries, n, left)
        new = HI.rolled_back_inventory(_disk(spark, disk), res)
        assert sorted(r.relative_path for r in new.collect()) == left


def test_dry_run_checks_the_tree_as_is(spark):
    disk = _disk(spark, ["a.py", "b.py", "docs/x.md"])
    df = spark.createDataFrame(
        [("r", 1, 1, "move", "a.py", "src/a.py", "low", True),
         ("r", 1, 2, "move", "b.py", "src/a.py", "low", True),      # same target: passes in a dry run
         ("r", 1, 3, "move", "docs", "x/docs", "low", True),
         ("r", 1, 4, "move", "nope.py", "x.py", "low", True),
         ("r", 1, 5, "move", "a.py", "docs", "low", True),
         ("r", 1, 6, "move", "b.py", "a.py/z.py", "low", True)],
        "repo_id string, phase int, ord bigint, action string, source string, target string, risk string, "
        "approved boolean")
    got = {r["ord"]: r["message"] for r in MV.validate_moves(df, disk).collect()}
    assert got == {
        1: "[DRY-RUN] Would move a.py -> src/a.py", 2: "[DRY-RUN] Would move b.py -> src/a.py",
        3: "Validation failed: Source is not a file: r/docs",
        4: "Validation failed: Source file does not exist: r/nope.py",
        5: "Validation failed: Target already exists (conflict): r/docs",
        6: "Validation failed: Target parent exists but is not a directory: r/a.py"}
    real = {r["ord"]: r["success"] for r in MV.apply_moves(df, disk).collect()}
    assert real[1] and not real[2]


def test_decisions_and_quit(spark):
    mv = spark.createDataFrame([("r", 1, i, "move", f"f{i}.py", f"src/f{i}.py") for i in range(5)],
                               "repo_id string, phase int, ord bigint, action string, source string, target string")
    dec = spark.createDataFrame([("r", "f0.py", "Y"), ("r", "f1.py", "no"), ("r", "f2.py", "yes"),
                                 ("r", "f3.py", "q")], "repo_id string, source string, decision string")
    got = {r["ord"]: r["approved"] for r in MV.with_decisions(mv, dec).collect()}
    assert got == {0: True, 1: False, 2: True}
    assert MV.with_decisions(mv, dec, approve_all=True).filter("approved").count() == 5


def test_last_moves_and_undoable(spark):
    hist = spark.createDataFrame(
        [("r", 1, "move", True, False), ("r", 2, "MOVE", True, None), ("r", 3, "move", False, False),
         ("r", 4, "Move", True, True), ("r", 5, "flag", True, False), ("r", 6, "move", True, False)],
        "repo_id string, seq bigint, action string, success boolean, skipped boolean")
    assert sorted(r["seq"] for r in HI.undoable(hist).collect()) == [1, 2, 6]
    last = HI.last_moves(hist, 2).orderBy("undo_rank").collect()
    assert [(r["seq"], r["undo_rank"]) for r in last] == [(6, 1), (2, 2)]
    assert HI.last_moves(hist, 10).count() == 3


def test_rollback_isolated_entries_match_sequential_replay(spark):
    rng = random.Random(23)
    names = [f"n{i}" for i in range(12)] + ["m.py", "k.py"]

    def path(depth):
        return "/".join(rng.choice(names) for _ in range(rng.randint(1, depth)))
    for n in (5, 60):
        disk = {path(3) for _ in range(40)}
        disk = {p for p in disk if not any(q.startswith(p + "/") for q in disk)}
        files = sorted(disk)
        entries = []
        for seq in range(1, 60):
            # mostly: moved files that exist at their target now (undo should work)
            t = rng.choice(files) if rng.random() < 0.9 else path(3)
            s = f"u{rng.randint(0, 30)}/" + path(2)      # destinations mostly free
            if s != t:
                entries.append((seq, s, t))
        hist = spark.createDataFrame(
            [("r", seq, "move", s, t, True, None) for seq, s, t in entries],
            "repo_id string, seq bigint, action string, source string, target string, success boolean, "
            "skipped boolean")
        res = HI.rollback(hist, _disk(spark, disk), n).checkpoint(eager=True)
        left = []
        got = {r["undone_seq"]: (r["success"], r["message"]) for r in res.collect()}
        assert got == brute_rollback(disk, entries, n, left)
        new = HI.rolled_back_inventory(_disk(spark, disk), res)
        assert sorted(r.relative_path for r in new.collect()) == left
