"""Nodes, chunks and definitions of source files: 16 languages, strings and comments, second versions, linear cost."""

import random
import re
import time

import pytest

from loomgrid.operators import chunking, code_chunks, search, symbols, syntax

PYTHON = '''import os
X = """
def fake():
    pass
"""
@dec(1)
class Cart(Base):
    """doc
    class inner doc
    """
    def total(self,
              b):
        if x:
            return 1
        else:
            return 2

    async def pay(self):
        pass

def main():
    pass
'''
CASES = {
    "rust": (
        '/// doc\n#[derive(Debug)]\npub struct P<T> {\n    x: i32,\n}\n\nimpl<T: Ord> Tr for P<T> {\n    pub fn get(&self) -> i32 {\n        let s = "fn fake() {";\n        // fn other() {\n        \'a: loop { }\n    }\n    fn two<\'a>(x: &\'a str) -> char { \'{\' }\n}\nenum E { A, B }\nconst N: usize = 3;\n',
        [(2, 5, 0, "struct", "P"), (7, 14, 0, "impl", "P<T>"), (8, 12, 1, "fn", "get"), (13, 13, 1, "fn", "two"), (15, 15, 0, "enum", "E"), (16, 16, 0, "const", "N")],
    ),
    "python": (PYTHON, [(6, 19, 0, "class", "Cart"), (11, 16, 1, "def", "total"), (18, 19, 1, "def", "pay"), (21, 22, 0, "def", "main")]),
    "c": (
        "#include <x.h>\n#define F(x) \\\n  foo {\nstatic struct foo *make(struct bar *b)\n{\n    if (b) {\n        return 0;\n    } else {\n        call(b);\n    }\n}\nstruct pt { int x; };\ntypedef struct { int y; } T;\nint main(void) { return '{'; }\n",
        [(4, 11, 0, "function", "make"), (12, 12, 0, "struct", "pt"), (14, 14, 0, "function", "main")],
    ),
    "cpp": (
        'namespace n {\ntemplate <typename T>\nclass A : public B<T> {\npublic:\n    A() : x(1) {}\n    virtual int f(int a) const override {\n        return g(a);\n    }\n};\n}\nint n::A::run(int x) { const char* s = R"x(class Z {)x"; return 1; }\n',
        [(1, 10, 0, "namespace", "n"), (2, 9, 1, "class", "A"), (5, 5, 2, "function", "A"), (6, 8, 2, "function", "f"), (11, 11, 0, "function", "n::A::run")],
    ),
    "java": (
        'package p;\n@Anno(x = 1)\npublic class A extends B {\n    /** void no() { */\n    @Override\n    public int f(int x) throws E {\n        foo(x);\n        String s = "class Q {";\n    }\n    interface I { void g(); }\n}\n',
        [(2, 11, 0, "class", "A"), (5, 9, 1, "function", "f"), (10, 10, 1, "interface", "I")],
    ),
    "javascript": (
        'import x from "y";\nconst f = (a) => {\n  return `class ${a} {`;\n};\nfunction g() { return /[{]/.test(x); }\nclass K extends L {\n  m(a) {\n    if (a) { b(); }\n  }\n  async n() {}\n}\ndescribe("x", () => {\n  it("y", function() { });\n});\n',
        [(2, 4, 0, "function", "f"), (5, 5, 0, "function", "g"), (6, 11, 0, "class", "K"), (7, 9, 1, "function", "m"), (10, 10, 1, "function", "n")],
    ),
    "typescript": (
        "interface I {\n  a: string;\n  m(x: number): void;\n}\nexport class A implements I {\n  private x = 1;\n  m(x: number): void {\n    call(x);\n  }\n}\ntype T = { a: string };\nenum E { A }\nexport const h = async (a: string): Promise<void> => {\n};\n",
        [(1, 4, 0, "interface", "I"), (3, 3, 1, "function", "m"), (5, 10, 0, "class", "A"), (7, 9, 1, "function", "m"), (11, 11, 0, "type", "T"), (12, 12, 0, "enum", "E"), (13, 14, 0, "function", "h")],
    ),
    "go": ("package main\ntype T struct {\n\tx int\n}\nfunc (t *T) Get() int {\n\ts := `func fake() {`\n\treturn t.x\n}\n", [(2, 4, 0, "type", "T"), (5, 8, 0, "func", "Get")]),
    "ruby": (
        'module M\n  class A < B\n    def f(x)\n      return 1 if x\n      y.each do |z|\n        puts "class Q"\n      end\n    end\n    def self.g; end\n  end\nend\n=begin\nclass No\n=end\n',
        [(1, 11, 0, "module", "M"), (2, 10, 1, "class", "A"), (3, 8, 2, "def", "f"), (9, 9, 2, "def", "self.g")],
    ),
    "lua": ('function M.f(a)\n  if a then\n    return "function g()"\n  elseif b then\n    for i=1,2 do print(i) end\n  end\nend\n--[[ function z()\nend ]]\nlocal function h() end\n', [(1, 7, 0, "function", "M.f"), (10, 10, 0, "function", "h")]),
    "bash": ('function a() {\n  if [ -f x ]; then\n    echo "b() {"\n  fi\n}\nb() {\n  cat <<EOF\nc() {\nEOF\n  for i in 1 2; do\n    echo $i\n  done\n}\n', [(1, 5, 0, "function", "a"), (6, 13, 0, "function", "b")]),
    "php": ('<?php\nnamespace A;\n#[Attr]\nclass B extends C {\n    public function f($x) { return "class Q {"; }\n}\n', [(2, 2, 0, "namespace", "A"), (3, 6, 0, "class", "B"), (5, 5, 1, "function", "f")]),
    "swift": ("struct S: P {\n    let x = 1\n    func f() -> Int {\n        return x\n    }\n}\nextension S { }\n", [(1, 6, 0, "struct", "S"), (3, 5, 1, "func", "f"), (7, 7, 0, "extension", "S")]),
    "scala": ('object O extends T {\n  val x = """\n  def no = 1\n"""\n  def f(a: Int): Int = {\n    a\n  }\n}\ncase class P(x: Int)\n', [(1, 8, 0, "object", "O"), (2, 4, 1, "val", "x"), (5, 7, 1, "def", "f"), (9, 9, 0, "class", "P")]),
    "csharp": (
        'namespace N\n{\n    [Attr]\n    public class A : B\n    {\n        public int F(int x)\n        {\n            return @"class ""Q"" {".Length;\n        }\n    }\n}\n',
        [(1, 11, 0, "namespace", "N"), (3, 10, 1, "class", "A"), (6, 9, 2, "function", "F")],
    ),
    "dart": ("class A extends B {\n  final int x;\n  A(this.x);\n  int f(int y) {\n    return y;\n  }\n  int g() => 1;\n}\nvoid main() { print('class Z {'); }\n", [(1, 8, 0, "class", "A"), (4, 6, 1, "function", "f"), (7, 7, 1, "function", "g"), (9, 9, 0, "function", "main")]),
}


@pytest.mark.parametrize("language", sorted(syntax.LANGUAGES))
def test_definitions_of_a_language(language):
    text, want = CASES[language]
    assert syntax.symbol_rows(text, language, 9) == want
    assert syntax.symbol_rows(text, language, 1) == [r for r in want if r[2] == 0] and syntax.symbol_rows("", language, 9) == []


def made_source(rng, n):
    """Nested blocks of a language with braces, one statement a line."""
    out, open_ = [], 0
    for k in range(n):
        kind = rng.random()
        pad = "  " * open_
        if kind < 0.15:
            out.append(f"{pad}// note {{ {k}")
        elif kind < 0.25:
            out.append("")
        elif kind < 0.4 and open_ < 7:
            out.append(f"{pad}int block{k}(int a) {{")
            open_ += 1
        elif kind < 0.5 and open_:
            open_ -= 1
            out.append("  " * open_ + "}")
        else:
            out.append(f'{pad}call{k}("{{", {"x" * rng.randint(1, 200)});')
    return "\n".join(out + ["  " * k + "}" for k in reversed(range(open_))])


def blocks_of(lines, low, high):
    """Second version of a level's nodes: (start, end, comment, inner lines), by counting braces from each line on."""
    out, i = [], low
    while i <= high:
        line = lines[i - 1].strip()
        if not line:
            i += 1
            continue
        code = "" if line.startswith("//") else re.sub(r'"[^"]*"', "", line)
        deep, j = code.count("{") - code.count("}"), i
        while deep > 0 and j < high:
            j += 1
            inner = lines[j - 1].strip()
            code = "" if inner.startswith("//") else re.sub(r'"[^"]*"', "", inner)
            deep += code.count("{") - code.count("}")
        out.append((i, j, line.startswith("//"), (i + 1, j - 1)))
        i = j + 1
    return out


def chunks_of(lines, low, high):
    def size(a, b):
        return sum(len(re.sub(r"\s", "", x).encode()) for x in lines[a - 1 : b])

    out, own, held = [], [], 0

    def flush(some):
        if some:
            out.append((some[0][0], some[-1][1], "merged" if len(some) > 1 else "block"))

    for b in blocks_of(lines, low, high):
        n = size(b[0], b[1])
        inner = any(x.strip() for x in lines[b[3][0] - 1 : b[3][1]])
        if n > syntax.MOST and inner:
            flush(own)
            own, held = [], 0
            out += chunks_of(lines, *b[3])
        elif n >= syntax.OWN:
            start = b[0]
            while own and own[-1][2] and own[-1][1] + 1 == start:
                start = own.pop()[0]
            flush(own)
            own, held = [], 0
            out.append((start, b[1], "block"))
        else:
            if held + n > syntax.MOST:
                flush(own)
                own, held = [], 0
            own.append(b)
            held += n
    flush(own)
    return out


def test_chunks_against_a_second_version():
    rng = random.Random(2)
    deep = 0
    for _ in range(150):
        text = made_source(rng, rng.randint(1, 160))
        lines = text.split("\n")
        want = chunks_of(lines, 1, len(lines))
        covered = {i for a, b, _ in want for i in range(a, b + 1)}
        got = syntax.chunk_rows(text, "c")
        assert [r[:3] for r in got if r[2] != "gap"] == sorted(want)
        gaps = [i for a, b, kind, _ in got if kind == "gap" for i in range(a, b + 1)]
        assert gaps == [i for i, x in enumerate(lines, 1) if x.strip() and i not in covered]
        deep = max(deep, max((r[3].count(".") for r in got), default=0))
    assert deep >= 4


def cut_of(text, markdown):
    """Second version of the text cutter: groups of line numbers."""
    groups, scope, heads = [], "", {}
    for i, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            groups.append([])
            continue
        size = len(re.sub(r"[ \t\n\f\r]", "", line).encode())
        if markdown and line.startswith("#"):
            scope = line.lstrip("#").strip()
            groups.append([])
        if not groups or sum(s for _, _, s in groups[-1]) + size > chunking.MAX_BYTES and groups[-1]:
            groups.append([])
        groups[-1].append((i, line, size))
        heads[i] = scope
    return [(g[0][0], g[-1][0], heads[g[0][0]], "\n".join(x for _, x, _ in g)) for g in groups if g]


def test_text_is_cut_like_a_second_version():
    rng = random.Random(3)
    for _ in range(300):
        text = "\n".join(rng.choice(["", " ", "# Head one", "## é", "word " * rng.randint(1, 60), "x" * rng.randint(1, 1800)]) for _ in range(rng.randint(0, 40)))
        for markdown in (False, True):
            assert list(chunking.cut_text(text, markdown)) == cut_of(text, markdown)


def test_cutting_is_linear():
    def took(f, text):
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            f(text)
            best = min(best, time.perf_counter() - began)
        return best

    rng = random.Random(4)
    small, large = made_source(rng, 4_000), made_source(rng, 16_000)
    words = "\n".join("word " * 9 for _ in range(4_000))
    for f, a, b in ((lambda t: syntax.chunk_rows(t, "java"), small, large), (lambda t: syntax.symbol_rows(t, "java", 3), small, large), (lambda t: list(chunking.cut_text(t)), words, "\n".join([words] * 4))):
        assert took(f, b) < 8 * took(f, a) + 0.05
    odd = "f(" * 40_000 + "{" * 5 + "template<" * 2_000 + '"""' + "/*" * 9_000
    for language in syntax.LANGUAGES:
        assert took(lambda t, k=language: syntax.parse(t, k), odd) < 10


def test_files_of_one_name_are_cut_each(spark):
    rows = [("a.py", "python", PYTHON), ("a.py", "python", "x = 1\n"), ("a.py", "PYTHON", PYTHON), ("b.c", "c", None), ("n", None, "text\n\nmore"), (None, "rust", "fn a() {}\r\n"), ("t.md", "md", "# H\nbody")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "file string, language string, content string, start int")
    got = sorted((r.file or "", r.start, r.end, r.kind, r.scope) for r in code_chunks.chunk_files(d).collect())
    alone = sorted((r.file or "", r.start, r.end, r.kind, r.scope) for x in rows for r in code_chunks.chunk_files(spark.createDataFrame([x], "file string, language string, content string")).collect())
    assert got == alone and ("", 1, 1, "block", "a") in got and ("t.md", 1, 2, "text", "H") in got
    assert symbols.definitions(d, language="py").count() == 2 * len(CASES["python"][1]) and symbols.definitions(d.where("false")).collect() == []


def test_contained_and_touched_in_one_large_file(spark):
    """Sweeps against all pairs on small files; 200,000 ranges of one file in one pass."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), rng.randint(0, 40), rng.choice([1, 2, 3, 9, None]), "x") for _ in range(400)]
    d = spark.createDataFrame(rows, 'file string, start int, end int, rank int, "more" string'.replace('"', "`"))
    whole = lambda r: None not in r[:4]
    want = sorted(str(r) for r in rows if not whole(r) or not any(whole(b) and b[0] == r[0] and b[3] < r[3] and b[1] <= r[1] and r[2] <= b[2] for b in rows))
    assert sorted(str(tuple(r)) for r in search.drop_contained(d).collect()) == want
    hunks = [(rng.choice(["a", "b", "c", None]), a := rng.randint(0, 40), a + rng.randint(-1, 3)) for _ in range(12)]
    h = spark.createDataFrame(hunks, "file string, start int, end int")
    touched = sorted(str(r) for r in rows if r[0] is not None and any(k[0] == r[0] and r[1] <= k[2] and r[2] >= k[1] for k in hunks))
    assert sorted(str(tuple(r)) for r in search.overlaps_hunk(d, h).collect()) == touched
    many = spark.range(200_000).selectExpr("'f' AS file", "int(id) AS start", "int(id + id % 1000) AS end", "int(id * 7919 % 200003) AS rank")
    assert 0 < search.drop_contained(many).count() < 200_000
    plan = search.overlaps_hunk(many, many)._jdf.queryExecution().executedPlan().treeString()
    assert "Join" not in plan and search.overlaps_hunk(many, many.where("start % 5000 = 0")).count() > 0


def test_nearest_in_tiles(spark, monkeypatch):
    """The same nearest vectors, with ties, by one block of queries and by tiles; at most k rows a query and task."""
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(500)] + [(600, None), (601, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = []
    for q, a in rows[::7]:
        if a is not None:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if b is not None and i != q)[:6]
            want += [(q, i, n, -s) for n, (s, i) in enumerate(near, 1)]
    asked = v.where("vec_id % 7 = 0")
    key = lambda df: sorted((r.query, r.id, r["rank"], r.score) for r in df.collect())
    assert key(search.knn(v, asked, 6)) == sorted(want)
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    monkeypatch.setattr(search, "VECTOR_TILE", 90)
    monkeypatch.setattr(search, "TILE", 7)
    tiled = search.knn(v, asked, 6)
    assert key(tiled) == sorted(want) and "NestedLoop" not in tiled._jdf.queryExecution().executedPlan().treeString()
    assert search.knn(v, asked.where("false"), 6).count() == search.knn(v, asked, 0).count() == search.knn(v.where("false"), asked, 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        search.knn(v.union(spark.createDataFrame([(700, [1.0])], v.schema)), asked, 6).collect()
