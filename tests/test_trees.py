"""Trees and their index: ignore rules, names of git, changes without reading files, searches that bring the index up to date."""

import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import hunks, store, tree
from loomgrid.operators.retrieve import Options
from loomgrid.sources.files import IgnoreRules, git_changed_since, git_diff_lines, git_dirty, git_head, ignored, source_files

LEXICAL = Options(mode="lexical", threshold=0.0)


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_twenty_thousand_rules(spark):
    rules = [("", f"gen{i}/") for i in range(10_000)] + [("", f"*.e{i}") for i in range(5_000)] + [("", f"/top/name{i}.txt") for i in range(4_990)] + [("", "!keep.e7"), ("sub/", "*.log"), ("sub/", "!a?.log"), ("", "doc/**/x.md"), ("deep/", "one"), ("", "[ab]c.py"), ("", "!gen1/kept.py")]
    cases = {
        "gen77/x/y.py": True, "gen77": False, "a/gen77/z": True, "x.e7": True, "q/keep.e7": False, "top/name3.txt": True, "a/top/name3.txt": False,
        "sub/x.log": True, "sub/ab.log": False, "x.log": False, "sub/deep/x.log": True, "doc/x.md": True, "doc/p/q/x.md": True, "deep/one/two": True,
        "one/two": False, "ac.py": True, "z/bc.py": True, "cc.py": False, "gen1/kept.py": False, "plain": False,
    }
    test = IgnoreRules(rules)
    assert {k: test(k) for k in cases} == cases
    names = spark.createDataFrame([(k,) for k in cases], "file string")
    assert {r.file: r.i for r in names.select("file", ignored(F.col("file"), rules).alias("i")).collect()} == cases
    rng = random.Random(3)
    began = time.time()
    for _ in range(20_000):
        test("/".join(f"{rng.choice(['gen', 'a', 'b'])}{rng.randint(0, 20_000)}" for _ in range(4)) + ".e9")
    assert time.time() - began < 20


def test_names_that_git_quotes(spark, tmp_path):
    git(tmp_path, "init", "-q")
    names = ["grün.py", 'a "b".txt', "tab\there.txt", "two words.txt", "back\\slash.txt", "plain.txt"]
    for n in names:
        (tmp_path / n).write_text("one\ntwo\n")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "first")
    for n in names:
        (tmp_path / n).write_text("one\n2\n")
    got = {(r.file, r.start, r.end) for r in hunks.parse_diff(git_diff_lines(spark, str(tmp_path))).collect()}
    assert got == {(n, 2, 2) for n in names}
    quoted = spark.createDataFrame([("d", 1, '+++ "b/gr\\303\\274n.py"'), ("d", 2, "@@ -1 +1 @@"), ("d", 3, '+++ "b/\\320\\226\\a.py"'), ("d", 4, "@@ -1 +1 @@")], "source string, line_no int, line string")
    assert sorted(r.file for r in hunks.parse_diff(quoted).collect()) == ["grün.py", "Ж\a.py"]
    assert git_dirty(str(tmp_path)) == sorted(names)


@pytest.mark.parametrize("with_git", [True, False])
def test_search_brings_the_index_up_to_date(spark, tmp_path, with_git):
    root, path = tmp_path / "tree", str(tmp_path / "index")
    (root / "sub").mkdir(parents=True)
    for n, text in {"a.py": "def alpha():\n    pass\n", "sub/b.rs": "fn beta() {}\n", "c.txt": "gamma\n", "zero.txt": "x\0y"}.items():
        (root / n).write_text(text)
    if with_git:
        git(root, "init", "-q")
        git(root, "add", "-A")
        git(root, "commit", "-qm", "first")
    t = tree.Tree(str(root), path)

    def found(query, **how):
        rows, state = tree.search(spark, t, query, LEXICAL, **how)
        return [r.file for r in rows.collect()], state

    with pytest.raises(FileNotFoundError):
        found("alpha", reindex="never")
    assert found("alpha") == (["a.py"], {"state": "made", "added": 3})
    if with_git:
        assert found("beta") == (["sub/b.rs"], {"state": "fresh"})
    (root / "a.py").write_text("def delta_one():\n    return 1\n")
    (root / "new.go").write_text("func epsilon() {}\n")
    (root / "c.txt").unlink()
    changed = {"added": 1, "changed": 1, "removed": 1}
    assert tree.refresh(spark, t, "never")[1] == {"state": "stale", **changed}
    assert found("delta", most_changed=2) == ([], {"state": "stale", **changed})
    assert found("delta") == (["a.py"], {"state": "updated", **changed})
    assert found("gamma") == ([], {"state": "fresh"})
    kept = store.load(spark, path)
    assert {r.file for r in kept.manifest.collect()} == {"a.py", "new.go", "sub/b.rs"} and kept.meta["number"] == 1
    if with_git:
        head = git_head(str(root))
        git(root, "add", "-A")
        git(root, "commit", "-qm", "second")
        assert git_changed_since(str(root), head) == ["a.py", "c.txt", "new.go"] and git_changed_since(str(root), "0" * 40) is None
        assert tree.refresh(spark, t)[1] == {"state": "fresh"}
        # only files that git names are read
        assert tree.candidates(spark, t, kept)[0] == ["a.py", "new.go"]
        git(root, "revert", "--no-edit", "HEAD")
        assert found("gamma")[1] == {"state": "updated", "added": 1, "changed": 1, "removed": 1}
        assert found("epsilon")[0] == []
    else:
        # an uncounted binary file is looked at again and stays out
        assert tree.candidates(spark, t, kept)[0] == ["zero.txt"]
    with pytest.raises(ValueError):
        found("x", reindex="sometimes")
    with pytest.raises(ValueError):
        tree.search(spark, t, "alpha", Options(mode="semantic"))


def test_named_files_are_read_alone(spark, tmp_path):
    for n in ("a.txt", "b[1].txt", "c*.txt", "{d}.txt"):
        (tmp_path / n).write_text(n)
    (tmp_path / "b1.txt").write_text("no")
    got = source_files(spark, str(tmp_path), names=["b[1].txt", "c*.txt", "{d}.txt"])
    assert sorted(r.content for r in got.collect()) == ["b[1].txt", "c*.txt", "{d}.txt"]
    assert source_files(spark, str(tmp_path), names=[]).collect() == []


def test_search_in_one_text(spark):
    text = "import os\n\ndef getUserName(x):\n    return x\n\ndef other():\n    pass\n" + "".join(f"value_{i} = compute({i}, {i})\n" for i in range(60))
    r = tree.search_content(spark, text, "user", "py", LEXICAL).collect()
    assert [(x.file, x.language) for x in r] == [("<stdin>", "python")] and "getUserName" in r[0].content
    assert tree.search_content(spark, " \n", "user", "py", LEXICAL).collect() == tree.search_content(spark, text, " ", "py", LEXICAL).collect() == []
    lengths = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert tree.search_content(spark, "alpha\n\nbeta", "alpha", o=Options(mode="semantic", threshold=0.0), embedder=lengths, dimension=2).count() == 2
