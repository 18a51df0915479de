from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import chunks as C
from cairn.operators import extraction as X
from cairn.operators import grounding as GR
from cairn.operators import hierarchy as H


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_chunk_rules(spark):
    assert list(C.windows("x" * 1400, 1500, 200)) == [(0, 1400), (1300, 1400)]
    assert list(C.windows("x" * 1300, 1500, 200)) == [(0, 1300)]
    text = "a" * 900 + "\n" + "b" * 900
    files = spark.createDataFrame([("p", text), ("empty", " \n"), ("null", None), ("q", "l1\r\nl2\x00\rl3\n")], "path string, content string")
    got = sorted(tuple(r) for r in C.chunk(files).collect())
    assert got == [("p", 0, "a" * 900, 1, 1), ("p", 1, text[701:], 1, 2), ("q", 0, "l1\nl2\nl3", 1, 3)]


def test_breadcrumbs_and_packing(spark):
    files = spark.createDataFrame([("src/a.py", "x\ny", "m")], "path string, content string, module string")
    row = C.with_breadcrumbs(C.chunk(C.with_header(files)), "workspace").first()
    assert row.text == "Context: Block=backend | Module=src | Level=code | Type=code\n[File: src/a.py]\nx\ny" and row.language == "python"
    packed = C.pack_lines(files.withColumn("content", F.lit("1234\n5678\nlong line here")), 12).orderBy("part").collect()
    assert [r.text for r in packed] == ["=== src/a.py ===\n", "1234\n5678\n", "long line here\n"]


def test_identifiers_and_annotations(spark):
    code = 'public class UserService { private int getUser(int id) {} }\ndef load_all(x):\n com.example.Foo my_var the'
    assert set(one(spark, code, T.identifiers)) >= {"UserService", "getUser", "load_all", "my_var"}
    assert one(spark, '@Path("/existFile/sub-dir") @Produces(X)', T.annotations) == ["Path", "Produces", "dir", "existFile", "sub"]
    assert [tuple(x) for x in one(spark, "MyClass my_fn MAX_LEN a.bc.de `@Path(\"x\")`", T.candidates)] == [
        ("MyClass", "camelcase"), ("my_fn", "snake_case"), ("MAX_LEN", "all_caps"), ("bc.de", "dotted"), ("Path", "backticked")
    ]


def test_levels_and_abstaining(spark):
    rows = spark.createDataFrame([("synthesis/L1_x.md", "context"), ("codex_a.md", "context"), ("n.md", "context"), ("r", "reports"), ("w", "workspace"), ("w", "?")], "p string, l string")
    assert [r[0] for r in rows.select(T.doc_level(F.col("p"), F.col("l"))).collect()] == ["L1", "L3", "context", "report", "code", "context"]
    assert one(spark, f"a\n {T.ABSTAIN} \nb {T.ABSTAIN}.", T.strip_abstain) == "a\nb (unknown)."
    paths = spark.createDataFrame([("src/auth/login.py",), ("src/main.py",), ("",), (".env",)], "p string")
    assert [tuple(r) for r in paths.select(T.module_path(F.col("p")), T.extension(F.col("p"))).collect()] == [("src/auth", ".py"), ("src", ".py"), ("", ""), (".env", "")]


PROSE = "`ExistFileResource` is mapped by @Path to `/existFile`. It calls `GhostThing` and MadeUpName."
SOURCE = '@Path("/existFile") public class ExistFileResource {}'


def test_unsupported_names(spark):
    prose = spark.createDataFrame([(1, PROSE, SOURCE, "java"), (2, PROSE, "", "unknown"), (3, None, None, "java")], "doc_id int, text string, source string, language string")
    allowed = spark.createDataFrame([("madeupname",)], "word string")
    got = GR.unknown_names(prose, allowed).collect()
    assert [(r.doc_id, r.name, r.kind) for r in got] == [(1, "GhostThing", "camelcase")] and "GhostThing" in got[0].snippet


def test_response_validation(spark):
    answers = spark.createDataFrame([(1, "Use alpha_fn. Then call ghost_fn. Done."), (2, f"{T.ABSTAIN}"), (3, " ".join(f"bad_{i}x." for i in range(9)))], "doc_id int, text string")
    cited = spark.createDataFrame([(1, "def alpha_fn")], "doc_id int, text string")
    got = {r.doc_id: (r.n_unknown, r.verdict, r.text) for r in GR.validate_responses(answers, cited, cited.limit(0), r"\b([a-z]+_[a-z0-9_]+)\b").collect()}
    assert got == {1: (1, "cleaned", "Use alpha_fn. Done."), 2: (0, "passed", T.ABSTAIN), 3: (9, "abstained", T.ABSTAIN)}


def test_citations(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"l{i}" for i in range(1, 301)))], "path string, content string")
    c = spark.createDataFrame([("a.py", 1, 3), ("b.py", 1, 1), ("a.py", 5, 301), ("a.py", 3, 2), ("a.py", 1, 250)], "path string, line_start int, line_end int")
    got = {(r.path, r.line_start, r.line_end): r.error for r in GR.check_citations(c, files).collect()}
    assert got == {("a.py", 1, 3): None, ("b.py", 1, 1): "path does not exist", ("a.py", 5, 301): "line range invalid", ("a.py", 3, 2): "line range invalid", ("a.py", 1, 250): "range too large"}
    assert {r.cited for r in GR.read_ranges(c.where("line_end = 3"), files).collect()} == {"l1\nl2\nl3"}


def test_entities(spark):
    labels = spark.createDataFrame([("1", "Billing Service"), ("2", "ledger"), ("3", "ab")], "id string, label string")
    prose = spark.createDataFrame([(1, "The billing service writes ledgre, ab."), (2, "nothing")], "doc_id int, text string")
    got = {(r.doc_id, r.id): round(r.confidence, 3) for r in GR.find_entities(prose, labels).collect()}
    assert got == {(1, "1"): 1.0, (1, "2"): round(10 / 12, 3)}



def test_copies_of_a_label_are_one_class(spark, tmp_path):
    from cairn.operators import retrieval as R

    names = [("Billing Service",), ("ledger",), ("ledger", "Billing Service"), ("cart",), ("ab",), (None,)]
    labels = spark.createDataFrame([(f"n{k}", name) for k in range(600) for name in names[k % 6]], "id string, label string")
    prose = spark.createDataFrame([(1, "The billing service writes ledgre, ab."), (2, "nothing"), (3, "a kart and a ledger")], "doc_id int, text string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k * 7 % 600}") for k in range(600)], "source_id string, target_id string")
    named, classes = GR.label_classes(labels, 3)
    assert {(r.n, *r.ids) for r in classes.collect()} == {(100, *sorted(f"n{k}" for k in range(m, 600, 6))[:3]) for m in range(5)}
    for enough in (3, 201):
        few = GR.find_entities(prose, named, 0.6, enough, native=True, classes=classes).withColumnRenamed("doc_id", "query_id")
        every = GR.find_entities(prose, labels, 0.6, enough, native=True).withColumnRenamed("doc_id", "query_id")
        assert few.count() * 100 == every.count() > 300
        want = {tuple(r) for r in R.entity_search(every, edges).collect()}
        assert {tuple(r) for r in R.entity_search(few, edges, classes=classes).collect()} == want
        assert {tuple(r) for r in R._top(few, 3, classes).collect()} == {tuple(r) for r in R._top(every, 3, None).collect()}


PROGRAMS = {
    "a.java": "import java.util.List;\npublic class Cart extends Base implements Shop {\n    private int total = 0;\n    public void add(int x) {\n        log(x);\n    }\n    public int sum() {\n        return total;\n    }\n}\n",
    "a.py": "import os\nclass Cart(Base):\n    def add(self, x):\n        log(x)\n    def sum(self):\n        return 1\n",
    "a.js": "import x from 'y'\nclass Cart extends Base {\n  add(x) {\n    log(x)\n  }\n  sum() {\n    return 1\n  }\n}\n",
    "a.ts": "import x from 'y'\nexport class Cart extends Base {\n  public add(x: number): void {\n    log(x)\n  }\n  sum(): number {\n    return 1\n  }\n}\n",
    "a.go": "package a\ntype Cart struct {\n\tn int\n}\nfunc (c *Cart) Add(x int) {\n\tlog(x)\n}\nfunc (c *Cart) Sum() int {\n\treturn 1\n}\n",
}


def test_same_program_in_five_languages(spark):
    nodes, edges = X.extract(spark.createDataFrame(list(PROGRAMS.items()), "path string, content string"))
    n, e = nodes.collect(), edges.collect()
    for path in PROGRAMS:
        kinds = [r.type for r in n if r.file_path == path]
        assert kinds.count("Class") >= 1 and kinds.count("Method") >= 2, path
        calls = [r for r in e if r.relation == "calls" and r.target_id == "UnresolvedCall:log" and f":{path}:" in r.source_id]
        assert len(calls) == 1 and calls[0].source_id.startswith("Method:"), path
    assert {r.target_id for r in e if r.relation == "implements"} == {"UnresolvedClass:Shop"}
    assert sum(r.relation == "extends" for r in e) == 4
    assert {(r.source_id, r.target_id) for r in e if r.relation == "contains" and "a.py" in r.source_id} == {("Class:a.py:2", "Method:a.py:3"), ("Class:a.py:2", "Method:a.py:5")}


def test_sentences_and_weights(spark):
    docs = spark.createDataFrame([(1, "One. Two!  one. Three"), (2, "A.\nB?"), (3, "")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in H.dedup_sentences(docs).collect()} == {1: "One. Two! Three...", 2: "A. B?", 3: ""}
    c = spark.createDataFrame([("p", "a", 10, 10240), ("p", "b", 1, 100), ("p", "c", 0, 0)], "parent string, child string, leaves int, size_bytes int")
    got = {r.child: (round(r.score, 2), r.weight) for r in H.child_weights(c).collect()}
    assert got == {"a": (1.0, "major"), "b": (0.1, "minor"), "c": (0.1, "minor")}


def test_methods_equal_their_pattern(spark):
    import random
    import re

    rng = random.Random(1)
    pattern = re.compile(r"\b(?:" + "|".join(T.MODIFIERS) + r"|\s)+\w[\w<>,\s]*\s+([a-z_][A-Za-z0-9_]+)\s*\(")
    parts = ["public", "static", "finally", "int", "Map<String,", "Integer>", "getUser", "é", "x1", "_a", "Foo", "(", ")", ";", "{", "new", ","]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["word " * 50_000, "a b " * 30_000 + "c("]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", T.methods(F.col("t")).alias("m")).collect():
        assert r.i >= 3000 or r.m == pattern.findall(texts[r.i]), texts[r.i]
    assert "getUser" in one(spark, "return String getUser(int id)", T.identifiers) and "that" not in one(spark, "that thing", T.identifiers)


def test_modules_are_packed_through(spark):
    files = spark.createDataFrame([("m", "a", "12345\n67"), ("m", "b", "x"), ("n", "a", None)], "module string, path string, content string")
    head = lambda p: ["=" * 60, f"[FILE: {p}]", "=" * 60]
    lines = {"m": [*head("a"), "12345", "67", *head("b"), "x"], "n": [*head("a"), ""]}
    for most in (20, 130, 1000):
        got = C.pack_modules(files.coalesce(1), most).orderBy("module", "task", "part").collect()
        for module, own in lines.items():
            want, held = [], ""
            for line in own:
                if held and len(held) + len(line) + 1 > most:
                    want.append(held)
                    held = ""
                held += line + "\n"
            assert [r.text for r in got if r.module == module] == [*want, held]
    assert got[0].paths == ["a", "b"] and C.pack_modules(files.limit(0)).count() == 0


def test_labels_of_any_length(spark, monkeypatch):
    import random

    from cairn.operators import matching

    prose = spark.createDataFrame([(1, "One two, three four-five six seven."), (2, "two three"), (3, None), (4, "")], "doc_id int, text string")
    labels = spark.createDataFrame([(1, "two three"), (2, "Two, Three"), (3, "seven"), (4, "ve"), (5, "..."), (6, "E"), (7, "ven."), (8, None), (9, "")], "id int, label string")
    assert sorted(tuple(r) for r in GR.mentions(prose, labels).collect()) == [(1, 2), (1, 3), (1, 7), (2, 1)]
    assert GR.mentions(prose, labels.limit(0)).count() == 0 and GR.mentions(prose.limit(0), labels).count() == 0
    # labels of 1 to 1000 words, ids that share a label, in many automata and slabs
    monkeypatch.setattr(matching, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(matching, "SLAB_BYTES", 10_000)
    rng = random.Random(2)
    words = [rng.choice(["über", "a", "is", "Graph", "node", "ß", "😀"]) for _ in range(4000)]
    texts = [" ".join(words[a : a + rng.randint(1, 2500)]) for a in rng.sample(range(4000), 30)]
    names = [" ".join(words[a : a + n]) for n in (1, 1, 2, 3, 5, 50, 1000) for a in rng.sample(range(4000), 8)] + ["graph"] * 30
    prose = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    labels = spark.createDataFrame(list(enumerate(names)), "id int, label string")
    want = sorted((d, i) for d, t in enumerate(texts) for i, x in enumerate(names) if len(x) >= 3 and x.lower() in t.lower())
    assert sorted(tuple(r) for r in GR.mentions(prose, labels).collect()) == want


def test_similar_words_equal_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(3)
    labels = ["".join(rng.choices("abcd", k=rng.randint(2, 12))) for _ in range(60)]
    words = set()
    for x in labels * 6:
        w = list(x)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", "bc"])
        words.add("".join(w))
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    table = spark.createDataFrame(list(enumerate(labels)), "id int, label string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for threshold in (0.6, 0.75, 0.9):
        for native in (True, False):
            ratio = (lambda a, b: 1 - distance(a, b) / max(len(a), len(b))) if native else (lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
            near = lambda a, b: 2 * min(len(a), len(b)) / (len(a) + len(b)) >= threshold
            want = {(w, i) for w in words for i, x in enumerate(labels) if min(len(w), len(x)) >= 3 and near(w, x) and ratio(w, x) >= threshold}
            assert {(r.word, r.id) for r in GR.similar_mentions(frame, table, threshold, native).collect()} == want


def test_stripping_is_linear(spark):
    import time

    from cairn.functions import text as T

    texts = ["a" + " " * 300_000 + "b", "  x　\x85\xa0", "\n\t", "", None, "no ends", "​kept​"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    got = rows.select(T.strip(F.col("t")).alias("s"), T.rstrip(F.col("t")).alias("r")).collect()
    assert [r.s for r in got] == [t and t.strip() for t in texts] and [r.r for r in got] == [t and t.rstrip() for t in texts]
    assert time.time() - began < 10


def test_extents_of_crossing_lines_and_long_files(spark):
    """All node and edge rows against plain loops, on ragged indentation and a file of a million lines."""
    import random
    import re
    import time

    rng = random.Random(12)
    kinds = [(w, re.compile(p)) for lang, w, p in X.PATTERNS if lang == "python"]

    def brute(path, content):
        lines = [(n, x, len(x) - len(re.sub(r"^\s+", "", x))) for n, x in enumerate(content.split("\n"), 1) if x.strip(" ")]
        last = max((n for n, _, _ in lines), default=0)
        nodes, edges, heads = [], set(), []
        for n, x, indent in lines:
            hits = [(w, m[1]) for w, p in kinds if (m := p.search(x))]
            own = {}
            for w, name in hits:
                if w in ("Class", "Method", "Field"):
                    own[name] = min(own.get(name, w), w)
                elif w == "imports":
                    edges.add((f"Module:{path}", f"Module:{name}", "imports"))
                else:
                    heads.append((n, name, w))
            count = {}
            for name in sorted(own):
                count[own[name]] = k = count.get(own[name], -1) + 1
                end = next((m for m, y, i in lines if m > n and i <= indent and y.strip(" ")[0] not in ")}]"), last + 1) - 1
                nodes.append((f"{own[name]}:{path}:{n}" + (f"#{k}" if k else ""), own[name], name, path, n, end))
        for n, base, w in heads:
            edges |= {(i, f"UnresolvedClass:{base}", w) for i, t, _, _, s, _ in nodes if s == n and t == "Class"}
        for n, x, _ in lines:
            around = [(e - s, i) for i, _, _, _, s, e in nodes if s <= n <= e]
            for callee in set(re.findall(r"(\w+)\s*\(", x)) - set(X.NOT_CALLS) - {name for _, _, name, _, s, _ in nodes if s == n}:
                if around:
                    edges.add((min(around)[1], f"UnresolvedCall:{callee}", "calls"))
        for i, _, _, _, s, e in nodes:
            out = [(f - r, -r, j) for j, _, _, _, r, f in nodes if r <= s and f >= e and (f - r > e - s or (r, f) == (s, e) and j < i)]
            if out:
                edges.add((min(out)[2], i, "contains"))
        return nodes, edges

    line = lambda: " " * rng.choice([0, 0, 2, 4, 4, 8, 9]) + rng.choice(["class Aé(Base):", "def go(x):", "class go: # def go", "go(Aé(1))", "}", ")", "import os.path", "", "x = 1", "async def très_long ():", "print(len(y))"])
    files = {f"f{n}.py": "\n".join(line() for _ in range(rng.randint(0, 60))) for n in range(40)} | {"none.py": "", "blank.py": "  \n"}
    frame = spark.createDataFrame([(p, c, "x") for p, c in files.items()] + [("void.py", None, "x")], "path string, content string, id string")
    nodes, edges = X.extract(frame)
    want = [brute(p, c) for p, c in files.items()]
    assert sorted(map(tuple, nodes.collect())) == sorted(n for own, _ in want for n in own)
    assert sorted(tuple(r)[:3] for r in edges.collect()) == sorted(e for _, own in want for e in own)
    # a million lines below one class
    long = "class Top:\n" + "    def m(self):\n        call(1)\n" * 500_000
    began = time.time()
    nodes, edges = X.extract(spark.createDataFrame([("long.py", long)], "path string, content string"))
    assert nodes.count() == 500_001 and edges.count() == 1_000_000 and time.time() - began < 90


def test_nesting_of_crossing_spans(spark):
    import random

    from cairn.operators import graph as G

    rng = random.Random(5)
    spans = [(f"n{i}", rng.choice(["a", "b", "c"]), s := rng.randrange(20_000), s + rng.choice([0, 3, 9, 50, 700])) for i in range(3000)]
    want = set()
    by = {}
    for span in spans:
        by.setdefault(span[1], []).append(span)
    for own in by.values():
        for i, _, s, e in own:
            out = [(f - r, -r, j) for j, _, r, f in own if r <= s and f >= e and (f - r > e - s or (r, f) == (s, e) and j < i)]
            if out:
                want.add((min(out)[2], i))
    frame = spark.createDataFrame(spans, "id string, file_path string, line_start int, line_end int")
    assert sorted(tuple(r) for r in G.nesting(frame).collect()) == sorted(want)
    assert G.nesting(frame.limit(0)).count() == 0


def test_names_of_long_texts(spark, monkeypatch):
    import time

    many = " ".join(f"name_{i}" for i in range(60_000))
    prose = spark.createDataFrame([(1, many, many[: 5000], "java"), (2, "`@Get(x)` is Foo_x, FooBar and `a b`; fooBAR\nFooBar", None, "python"), (3, "FooBar", "xfoobarx", "java")], "doc_id int, text string, source string, language string")
    allowed = spark.createDataFrame([("foo_x",)], "word string")
    began = time.time()
    got = GR.unknown_names(prose, allowed).collect()
    assert time.time() - began < 60
    assert {(r.name, r.kind) for r in got if r.doc_id == 2} == {("FooBar", "camelcase"), ("Get", "backticked"), ("a", "backticked")} and not [r for r in got if r.doc_id == 3]
    assert next(r.snippet for r in got if r.name == "Get") == "`@Get(x)` is Foo_x, FooBar and `a b`; fooBAR FooBar"[:65]
    one = {r.name for r in got if r.doc_id == 1}
    assert one == {f"name_{i}" for i in range(60_000) if f"name_{i}" not in many[:5000]}


def test_matching_blocks_equal_the_plain_ratio():
    import difflib
    import random

    from cairn.operators import similarity as S

    rng = random.Random(8)
    word = lambda n, abc: "".join(rng.choices(abc, k=n))
    pairs = [(word(rng.randint(0, 14), abc), word(rng.randint(0, 14), abc)) for abc in ("ab", "abcdé😀", "abcdefghij") for _ in range(400)]
    for _ in range(60):  # labels of 200 letters and more have popular ones
        x = word(rng.randint(150, 420), rng.choice(["abc", "abcdefghijklmnopqrstuvwxyz0123456789" * 4 + "é"]) + "".join(chr(c) for c in range(300, 500)))
        y = list(x)
        for _ in range(rng.randint(0, 120)):
            y[rng.randrange(len(y))] = rng.choice("abcz")
        pairs.append((x, "".join(y)[rng.randint(0, 30) :]))
    got = S.matched([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert got == [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]


def test_similar_words_of_ten_thousand_letters(spark):
    import random
    import time

    rng = random.Random(1)
    long = ["".join(rng.choices("abcdefghijklmnop", k=10_000)) for _ in range(3)]
    other = long[0][:4000] + "zz" + long[0][4100:]
    words = spark.createDataFrame([(w,) for w in [*long, "cart", "carts", None, "ab"]], "word string")
    short = spark.createDataFrame([(1, "cart"), (2, None), (3, "xy")], "id int, label string")
    GR.similar_mentions(words.limit(0), short).collect()
    began = time.time()
    assert {(r.word, r.id) for r in GR.similar_mentions(words, short).collect()} == {("cart", 1), ("carts", 1)}
    assert time.time() - began < 20
    labels = short.union(spark.createDataFrame([(4, other)], "id int, label string"))
    got = GR.similar_mentions(words, labels, native=True).where("id = 4").collect()
    assert [r.word for r in got] == [long[0]]
