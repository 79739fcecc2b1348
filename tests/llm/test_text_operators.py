"""Text operators against brute force, exact round trips, the library they must equal, and odd tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointframe.llm import buckets, graph, language, lines, neardup, pages, page_samples, pieces, quality, registry, resampling, secrets, spots, stages, tiling, topk, toxicity, vectors, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (3, "twice the same id", "en", None, 17), (3, "twice the same id", "en", None, 17),
    (None, "no id here at all, only words", "de", "b", 3), (4, "漢字とかな \U0001F600 \x00", "fr", "a", 9), (5, "word " * 30_000, "en", "a", 150_000), (6, "x" * 50_000, None, "b", 50_000),
    (7, "=:\"'<>&;{}[]" * 200, "en", "a", 10),
]

ODD_VECTORS = [
    (0, None, 1, "a", 1), (50, [], 1, None, 1), (100, [1.0, None], 1, "a", 1), (150, [float("nan"), 1.0], 1, "a", 1), (200, [float("inf"), 1.0], 1, "a", 1), (250, [1.0, 2.0, 3.0], 1, "a", 1),
    (None, [0.5, -0.25], 1, "a", 1), (300, [0.5, -0.25], None, "a", 1), (300, [0.5, -0.25], 1, "a", 1), (300, [-0.001, 0.75], 1, "a", 1), (7, [0.0, -0.0], 1, "a", 1), (9, [0.5, 0.5], 1, "a", 1), (8, [0.5, 0.5], 1, "a", 1),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, DOCS).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (4, None, None), (5, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<p>a<b>c</i></p></div><article>" * 50), (None, "w", "<script>never closed <p>x"), (5, "x", "no markup & <"), (5, "x", "no markup & <")], "page_id long, url string, html string").write.parquet(d + "/pages.parquet")
    spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>, label int, x string, rank int").write.parquet(d + "/embeddings.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "no id here at all, only words"), (3, "no id here at all, only words"), (None, "... !")], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(name, spark, odd_dir, empty_dir):
    rows = registry.QUERIES[name](spark, odd_dir).collect()
    if name == "op11_whitening":
        assert len(rows) == 2 * 7 and {r.n for r in rows} == {4} and rows[0].identity_error < 1e-12 and collections.Counter(r.vec_id for r in rows)[300] == 6
    elif name == "op13_topk":
        assert collections.Counter(r.query_id for r in rows) == {300: 15}
    elif name not in ("op1_decontamination", "op3_main_text"):
        assert len(rows) == len(ODD)
    if name == "op3_main_text":
        assert len(rows) == 6 and all(r.text is not None for r in rows)
    if name == "op1_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(None, 3)}
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


CLASHES = ["_host", "_HOST_", "_lines", "_kept", "_part", "_salt", "_hits", "_n", "_score", "_lang_pred", "score", "node", "bands", "size", "label", "bucket", "id", "class_id", "y", "sigs", "_order"]


def test_columns_with_clashing_names_stay(spark, odd_dir, monkeypatch):
    docs = spark.read.parquet(odd_dir + "/documents.parquet").withColumns({c: F.lit(c) for c in CLASHES})
    items = spark.read.parquet(odd_dir + "/benchmark.parquet")
    calls = {
        "op1": (lambda: tiling.contaminations(docs, items), {"hits"}), "op2": (lambda: secrets.find_secrets(docs), {"secrets"}), "op3": (lambda: pages.extract(docs, "text", "main"), {"main"}),
        "op4": (lambda: quality.score_statistics(quality.with_statistics(docs), None), {"stats", "score"}), "op5": (lambda: spots.with_next(docs, ["text"]), {"next_text"}),
        "op6": (lambda: lines.drop_boilerplate(docs), {"n_dropped"}), "op8": (lambda: pieces.encode_decode(docs, pieces.default_model()), {"ids", "decoded"}),
        "op9": (lambda: language.identify(docs, language.fit(docs)), {"lang_pred", "score", "ambiguous"}), "op10": (lambda: toxicity.find_passages(docs, toxicity.ToxicModel()), {"n_tokens", "passages"}),
        "keep_identified": (lambda: stages.keep_identified(docs), set()), "drop_repeated_lines": (lambda: stages.drop_repeated_lines(docs), set()),
        "keep_one": (lambda: stages.keep_one_of_each_class(docs), set()), "drop_contaminated": (lambda: stages.drop_contaminated(docs, items), set()),
    }
    for name, (call, new) in calls.items():
        out = call()
        stay = [c for c in docs.columns if c not in new]
        assert set(out.columns) == {*stay, *new}, name
        assert all(r[c] == c for r in out.collect() for c in CLASHES if c in stay and c not in new), name
    assert len(neardup.near_duplicates(docs).collect()) == len(spots.near_classes(docs).collect()) == len(ODD)
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)  # the other side of the size check
    assert {r["_part"] for r in lines.drop_boilerplate(docs).collect()} == {"_part"}


# 1. Tiling


def _naive_tiles(doc, item, least):
    least = min(least, len(item)) or 1
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and fd[d + k] and fi[i + k] and doc[d + k] == item[i + k]:
                    k += 1
                if k >= least and (best is None or (-k, i, d) < best):
                    best = (-k, i, d)
        if best is None:
            return out
        k, i, d = -best[0], best[1], best[2]
        out.append((d, i, k))
        fd[d : d + k], fi[i : i + k] = [False] * k, [False] * k


def test_tiles_equal_the_naive_ones():
    rng = random.Random(3)
    for _ in range(600):
        v = rng.randint(2, 6)
        doc, item = [rng.randrange(v) for _ in range(rng.randrange(40))], [rng.randrange(v) for _ in range(rng.randrange(1, 20))]
        if rng.random() < 0.5 and len(doc) > 5:
            a = rng.randrange(len(doc))
            item = doc[a:] + doc[:a][:8]
        least = rng.randint(1, 5)
        assert tiling.tile(doc, item, least) == _naive_tiles(doc, item, least)


def test_reordered_and_distant_passages_are_found(spark):
    item = " ".join(f"w{i}" for i in range(40))
    halves = " ".join(f"w{i}" for i in range(20, 40)), " ".join(f"w{i}" for i in range(20))
    far = halves[0] + " " + "filler " * 500 + halves[1]
    docs = spark.createDataFrame([(1, item), (2, far), (3, "w1 w2 w3 w4 w5 and no more"), (4, "short item")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "Short, item!")], "item_id long, text string")
    got = {r.doc_id: [(h.item_id, h.coverage) for h in r.hits] for r in tiling.contaminations(docs, items).collect()}
    assert got == {1: [(7, 1.0)], 2: [(7, 1.0)], 3: [], 4: [(8, 1.0)]}
    small = {r.doc_id: [(h.item_id, h.coverage) for h in r.hits] for r in _blocked(docs, items).collect()}
    assert small == got


def _blocked(docs, items):
    old, tiling.blocks = tiling.blocks, lambda *a: _blocks(*a[:3], 10)
    try:
        return tiling.contaminations(docs, items)
    finally:
        tiling.blocks = old


_blocks = tiling.blocks


# 2. Secrets


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["password", "Secret", "api_key", "apikey", "TOKEN", "=", ":", " ", '"', "'", "abcDEF123456", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f", "xyz", "\n", "."]
    whole = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [("assign", m.start(), m.end()) for m in whole.finditer(t) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        assert [s[:3] for s in secrets.scan(t) if s[0] != "literal"] == want


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('BASE = "Zx9kQ2"\ndb_password_hash = BASE + "vB7nM4pL"', ["Zx9kQ2", "vB7nM4pL"]),
        ("export DB_PWD=hunter2Hunter", ["hunter2Hunter"]),
        ('<add key="db.credential" value="S3cr3tValue99"/>', ["S3cr3tValue99"]),
        ("x: 5 apples and a token of love", []),
        ("public_key = 'A1b2C3d4E5f6'", []),
        ("auth_header = '${OTHER}'", []),
        ("db_auth := `Q1w2E3r4T5y6`", ["Q1w2E3r4T5y6"]),
    ],
)
def test_literals_that_reach_sensitive_names(text, found):
    assert [text[s:e] for k, s, e, *_ in secrets.scan(text) if k == "literal"] == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('config["db_credential"] = "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('os.environ["DB_PWD"] = \'S3cr3tValue99\'', ["S3cr3tValue99"]),
        ('$config{db_pwd} = "S3cr3tValue99";', ["S3cr3tValue99"]),
        ('$db_pwd = "S3cr3tValue99";', ["S3cr3tValue99"]),
        ('$env:DB_PWD = "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('  @db_pwd = "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('$base = "Zx9kQ2";\n$db_pwd = $base + "vB7nM4pL";', ["Zx9kQ2", "vB7nM4pL"]),
        ('parts["base"] = "Zx9kQ2"\ndb_pwd = parts["base"] + "vB7nM4pL"', ["Zx9kQ2", "vB7nM4pL"]),
        ('String db_pwd =\n    "S3cr3tValue99";', ["S3cr3tValue99"]),
        ('db_pwd = \\\r\n  "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('db_pwd = (\n    "Zx9kQ2"\n    "vB7nM4pL"\n)', ["Zx9kQ2", "vB7nM4pL"]),
        ('db_pwd = "Zx9kQ2"\n    + "vB7nM4pL"', ["Zx9kQ2", "vB7nM4pL"]),
        ('db_pwd = "Zx9kQ2" +\n"vB7nM4pL"', ["Zx9kQ2", "vB7nM4pL"]),
        ("db_pwd:\n  hunter2Hunter\nother: 1", ["hunter2Hunter"]),
        ("a:\n  db_pwd: |\n    hunter2Hunter\n\n    S3cr3tValue99\n  user: Q1w2E3r4T5y6", ["hunter2Hunter", "S3cr3tValue99"]),
        ('db_pwd = """\n  S3cr3tValue99\n"""', ["S3cr3tValue99"]),
        ("private_pem = '-- BEGIN --\nS3cr3tValue99S3cr\nQ1w2E3r4T5y6u7\n-- END --'", ["S3cr3tValue99S3cr", "Q1w2E3r4T5y6u7"]),
        ("DB_PWD=\nUSER_ID=hunter2Hunter", []),
        ('db_pwd:\n  "user9Name": x', []),
        ('auth:\n  user: hunter2Hunter', []),
        ('user = `\ndb_pwd = "S3cr3tValue99"\n`', ["S3cr3tValue99"]),
        ("db_pwd =", []),
    ],
)
def test_subscripts_sigils_and_values_over_lines(text, found):
    assert [text[s:e] for k, s, e, *_ in secrets.scan(text) if k == "literal"] == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('auth = base64.b64decode("czNjcjN0RGVmYXVsdDk5")', ["czNjcjN0RGVmYXVsdDk5"]),
        ('auth = load(read("S3cr3tValue99"), other)', ["S3cr3tValue99"]),
        ('auth = S3cr3tValue99Load(path)', []),
        ('conn = connect(user="root", db_pwd="S3cr3tValue99")', ["S3cr3tValue99"]),
        ('auth = connect(user="Q1w2E3r4T5", db_pwd="S3cr3tValue99")', ["S3cr3tValue99"]),
        ('db_pwd = ["S3cr3tValue99", "Q1w2E3r4T5y6"]', ["S3cr3tValue99", "Q1w2E3r4T5y6"]),
        ('"credentials": [\n  "S3cr3tValue99",\n  "Q1w2E3r4T5y6"\n], "user": "hunter2Hunter"', ["S3cr3tValue99", "Q1w2E3r4T5y6"]),
        ('"auth": {"user": "hunter2Hunter"}', []),
        ('db_pwd = ("S3cr3tValue99", "Q1w2E3r4T5y6")', ["S3cr3tValue99", "Q1w2E3r4T5y6"]),
        ('user, db_pwd = "hunter2Hunter", "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('db_pwd, user = "S3cr3tValue99", "hunter2Hunter"', ["S3cr3tValue99"]),
        ('f(a, db_pwd = "S3cr3tValue99", b = "hunter2Hunter")', ["S3cr3tValue99"]),
        ('db_pwd = live ? "S3cr3tValue99" : "Q1w2E3r4T5y6"', ["S3cr3tValue99", "Q1w2E3r4T5y6"]),
        ('db_pwd = a == b ? "S3cr3tValue99" : ""', ["S3cr3tValue99"]),
        ('db_pwd = "S3cr3tValue99" if live else "Q1w2E3r4T5y6"', ["S3cr3tValue99", "Q1w2E3r4T5y6"]),
        ('db_pwd = process.env.DB_PWD9x || "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('X = "S3cr3tValue99"\nauth = f"{X}"', ["S3cr3tValue99"]),
        ('X="S3cr3tValue99"\nDB_PWD="${X}"', ["S3cr3tValue99"]),
        ('X = "S3cr3tValue99"\nauth = "{X}"', []),
        ('db_pwd = b"S3cr3tValue99"', ["S3cr3tValue99"]),
        ('user.setPassword("S3cr3tValue99")', ["S3cr3tValue99"]),
        ('user.set_credential("S3cr3tValue99")', ["S3cr3tValue99"]),
        ('user.setName("S3cr3tValue99")', []),
        ('config.set("api_key", "S3cr3tValue99")', ["S3cr3tValue99"]),
        ('os.environ.get("AUTH", "S3cr3tValue99")', ["S3cr3tValue99"]),
        ('X = "S3cr3tValue99"\nconfig.put("db_pwd", X);', ["S3cr3tValue99"]),
        ('#define AUTH_KEY "S3cr3tValue99"', ["S3cr3tValue99"]),
        ('#define K "S3cr3tValue99"\nchar *auth = K;', ["S3cr3tValue99"]),
        ("<credential>S3cr3tValue99</credential>", ["S3cr3tValue99"]),
        ('<credential kind="x"> S3cr3tValue99 </credential>', ["S3cr3tValue99"]),
        ("<b>S3cr3tValue99</b>", []),
        ("tool --db-pwd S3cr3tValue99 --user hunter2Hunter", ["S3cr3tValue99"]),
        ("tool --db-pwd=S3cr3tValue99", ["S3cr3tValue99"]),
        ("a well--pwd thought", []),
        ('passphrase = "correct horse battery staple 9X"', []),
    ],
)
def test_calls_lists_choices_and_pairs_without_a_sign(text, found):
    assert [text[s:e] for k, s, e, *_ in secrets.scan(text) if k == "literal"] == found


@pytest.mark.parametrize("unit", ["a=f(", 'a=["x",', "pwd = c ? ", "x, ", "<pwd>", "--pwd ", "setPassword(", 'a = b or ', '"k": {', "a=b <c ", 'f"{a}" ', "a = (", "#define pwd a(\n"])
def test_scans_take_linear_time(unit):
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        secrets.scan(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)  # quadratic: 64 times


def test_every_literal_of_a_long_constant_is_followed():
    text = 'first = "S3cr3tValue99"\n' + "".join(f'first = first + "p{k}"\n' for k in range(3000)) + "db_pwd = first\n"
    assert text[10 - 1 : 22] == "S3cr3tValue99" and (9, 22, "db_pwd") in [x[:3] for x in secrets.lex(text)]
    doubled = 'x = "Zx9kQ2" + "vB7nM4pL"\n' + "x = x + x\n" * 200 + "db_pwd = x\n"
    assert [doubled[s:e] for s, e, *_ in secrets.lex(doubled)] == ["Zx9kQ2", "vB7nM4pL"]


# 3. Pages


def test_field_learns_unseen_layouts():
    model, wrong, total = pages.trained(), 0, 0
    for p in page_samples.sample_pages(120, seed=99):
        blocks = pages.read_blocks(p, marked=True)
        got = model.decode(pages.block_features(blocks))
        wrong += sum(y != (b.label or 0) for y, b in zip(got, blocks, strict=True))
        total += len(blocks)
    assert wrong <= 0.01 * total


@pytest.mark.parametrize(("kind", "blocks", "whole"), [("full", 0.99, 0.88), ("few", 0.99, 0.91), ("bare", 0.99, 0.96), ("plain", 0.99, 0.94)])
def test_every_kind_of_page(kind, blocks, whole):
    model, r, good, total, all_good = pages.trained(), random.Random(5), 0, 0, 0
    for _ in range(300):
        page = pages.read_blocks(page_samples.sample_page(r, kind), marked=True)
        wrong = sum(y != (b.label or 0) for y, b in zip(model.decode(pages.block_features(page)), page, strict=True))
        good, total, all_good = good + len(page) - wrong, total + len(page), all_good + (wrong == 0)
    assert good >= blocks * total and all_good >= whole * 300


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><h1>The Title</h1><p>Some words of the first paragraph stand here.</p></body>", "The Title\nSome words of the first paragraph stand here."),
        ("<body><h1>A walk</h1><p>We left early in the morning, before the sun was up.</p><p>It rained all day.</p><p>Nobody minded.</p></body>", "A walk\nWe left early in the morning, before the sun was up.\nIt rained all day.\nNobody minded."),
        ("<body><div><h1>A walk</h1><p>We left early in the morning.</p><p>It rained all day.</p></div></body>", "A walk\nWe left early in the morning.\nIt rained all day."),
        ("<body><p>Only a paragraph of text is on this page, and nothing else.</p></body>", "Only a paragraph of text is on this page, and nothing else."),
        ("<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><h1>Notes</h1><p>One short note is all there is today.</p><footer>© 2024 me</footer></body>", "Notes\nOne short note is all there is today."),
        ('<article><h1>T</h1><p>Seen words are here.</p><p style="display:none">Unseen words.</p><p hidden>Also unseen words.</p><div aria-hidden="true">And these.</div><p>Last words are here.</p></article>', "T\nSeen words are here.\nLast words are here."),
        ("<article><h1>T</h1><p>First words are here, some more of them.</p><p>Advertisement</p><p>Second words are here.</p><div>Sponsored</div><p>Third words.</p></article><footer>x</footer>", "T\nFirst words are here, some more of them.\nSecond words are here.\nThird words."),
    ],
)
def test_short_pages_hidden_parts_and_advert_labels(page, text):
    assert pages.main_text(page, pages.trained()) == text


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 9)
        f = pages.Field({str(k): float(v) for k, v in enumerate(rng.normal(size=n))}, rng.normal(size=(2, 2)))
        feats = [[str(k)] for k in range(n)]
        e = f.emissions(feats)
        value = lambda y: sum(e[k] * y[k] for k in range(n)) + sum(f.step[y[k - 1], y[k]] for k in range(1, n))  # noqa: B023, E731
        best = max(range(1 << n), key=lambda m: value([m >> k & 1 for k in range(n)]))
        assert f.decode(feats) == [best >> k & 1 for k in range(n)]


def test_main_text_of_a_page():
    html = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>
    <div class="cookie-banner">We use cookies</div><article><h1>A &amp; B</h1><p>One\n  two&nbsp;three.<p>Four <b>five</b><br>six.</p><div class="ad">Buy now</div></article>
    <section id="comments"><p>First!</p></section><aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert pages.main_text(html, pages.trained()) == "A & B\nOne two three.\nFour five six."


def test_marks_of_training_pages_are_not_read_from_others():
    page = '<div data-main="app.js"><p data-main>One two three four five.</p></div><main data-main=1>x</main>'
    assert [b.label for b in pages.read_blocks(page)] == [None, None]
    assert isinstance(pages.main_text(page, pages.trained()), str)
    assert [b.label for b in pages.read_blocks(page, marked=True)] == [None, 1]


def test_odd_markup_takes_linear_time():
    model = pages.trained()
    units = ["<div>", "<b></i>", "<a ", '<a b="', "<a '\">\"'", "</p ", "<!", "<script ", "</x>", "<p><td>", "<ul><li>", '<div class="ad q">', "&", "<span class=x>y", "<!-- ", "<table><tr><td>z"]
    names = "".join(f"<div class={''.join(chr(97 + k // 26**j % 26) for j in range(4))}>y" for k in range(50_000))
    for page in [names, *(u * (1_000_000 // len(u)) for u in units), *((u * (500_000 // len(u))) + ">" for u in units)]:
        began = time.process_time()
        pages.main_text(page, model)
        assert time.process_time() - began < 4, page[:20]


def test_gradient_is_that_of_the_log_likelihood():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 6))
        e, step, y = rng.normal(size=n), rng.normal(size=(2, 2)), rng.integers(0, 2, n).tolist()
        feats = [[str(k)] for k in range(n)]

        def log_p(e, step):
            value = lambda z: sum(e[k] * z[k] for k in range(n)) + sum(step[z[k - 1], z[k]] for k in range(1, n))  # noqa: B023, E731
            every = [value([m >> k & 1 for k in range(n)]) for m in range(1 << n)]
            return value(y) - np.log(np.sum(np.exp(every)))  # noqa: B023

        de, ds = pages.Field({str(k): float(v) for k, v in enumerate(e)}, step).gradient(feats, y)
        for k in range(n):
            up = e.copy()
            up[k] += 1e-6
            assert abs((log_p(up, step) - log_p(e, step)) / 1e-6 - de[k]) < 1e-4
        for i in range(2):
            for j in range(2):
                up = step.copy()
                up[i, j] += 1e-6
                assert abs((log_p(e, up) - log_p(e, step)) / 1e-6 - ds[i, j]) < 1e-4


# 4, 9, 10. Classifiers on held-out rows


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op4_quality(spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_languages_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = language.op9_language_id(spark, d).join(spark.read.parquet(d + "/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = toxicity.op10_toxicity(spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").toPandas()
    assert out[out.toxic == 1].predicted.mean() >= 0.89 and out[out.toxic == 0].predicted.mean() < 0.01


def test_folds_are_crc32(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", language.held_out().alias("a"), quality.held_out().alias("b")).collect()
    assert all(r.a == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.b == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_very_many_languages(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = [(30 * k + i, " ".join("".join(rng.choice(letters[5 * k : 5 * k + 5]) for _ in range(4)) for _ in range(20)), f"l{k:03}") for k in range(600) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs)).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.99 * len(got)


def test_code_words_differ():
    for k in (2, 3, 4, 6, 20, 2000):
        m = language.code_matrix(k)
        assert len({tuple(r) for r in m}) == k and (np.abs(m.sum(0)) < k).all()


def test_segments_take_linear_time():
    for every in (2, 4, 7):  # isolated tokens, each a segment of its own or part of a growing one
        took = []
        for n in (125_000, 1_000_000):
            began = time.process_time()
            found = toxicity.segments(np.where(np.arange(n) % every == 0, 3.0, 0.0), -2.0)
            took.append(time.process_time() - began)
            assert len(found) == -(-n // every)
        assert took[1] < 25 * max(took[0], 0.05)  # quadratic: 64 times


def test_segments_equal_their_definition():
    def rec(v, a, b):
        best = (0.0, 0, 0, 0)
        for i in range(a, b):
            c = 0.0
            for k in range(i, b):
                c += v[k]
                if c > best[0] + 1e-12:
                    best = (c, 0, i, k + 1)
        return [] if best[0] <= 0 else [*rec(v, a, best[2]), (best[2], best[3], best[0]), *rec(v, best[3], b)]

    rng = np.random.default_rng(0)
    for _ in range(200):
        v = rng.normal(size=rng.integers(0, 14))
        a, b = toxicity.segments(v, -0.2), rec(v - 0.2, 0, len(v))
        assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])


def test_word_counts_do_not_depend_on_batches(spark):
    rows = [("bad words here", 1)] * 40 + [("good words here", 0), ("good words there", 0), ("good words there", 0), ("bad words here", 0), (None, 0), ("", 0)]
    want = {"": (4, 1), "bad": (1, 1), "words": (3, 1), "here": (2, 1), "good": (2, 0), "there": (1, 0)}
    docs = spark.createDataFrame(rows, "text string, y int")
    for parts in (1, 7):
        assert {r.word: (r.clean, r.toxic) for r in toxicity.count_words(docs.repartition(parts)).collect()} == want


def test_toxicity_equals_brute_force_however_rows_are_batched(spark, tmp_path):
    rng, d = random.Random(3), str(tmp_path)
    plain, bad = [f"plain{k}" for k in range(60)], [f"vile{x}" for x in "abcdefgh"]
    docs, labels = [], []
    for k in range(240):
        toxic = int(k % 4 == 0)
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 25))] + [rng.choice(bad) for _ in range(toxic * rng.randrange(1, 4))]
        rng.shuffle(words)
        docs.append((k, " ".join(words) if k % 17 else docs[-1][1] if k else None))
        labels.append((k, toxic if k % 31 else 1 - toxic))
    docs += [(500, ""), (501, None), (502, "vilezz"), (503, "!!")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(d + "/labels.parquet")

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    y = {k: v for k, v in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    fit = {(t or "", y[k]) for k, t in docs if k in y}
    n1 = sum(v for _, v in fit)
    base = n1 / len(fit)
    sets = [(set(words(t)), v) for t, v in fit]
    n = {w: sum(w in s for s, _ in sets) for s, _ in sets for w in s}
    hits = {w: sum(w in s for s, v in sets if v) for w in n}

    def odds(w):
        share = base
        for k in range(3, 9):
            if len(w) > k:
                alike = [hits[x] * 10**6 // n[x] / 10**6 for x in n if len(x) > k and x[:k] == w[:k]]
                share = (sum(alike) + 5 * share) / (len(alike) + 5)
        h, m = hits.get(w, 0), n.get(w, 0)
        return math.log((h + 10 * share) / (m - h + 10 * (1 - share))) - math.log(base / (1 - base))

    best = {}
    for k, t in docs:
        v = [odds(w) - 2 for w in words(t)]
        best[k] = max([0.0] + [sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]), len(v)
    cal = toxicity.fit_calibration([(*best[k], y[k]) for k, _ in docs if k in y])

    def score(s, m):
        x = cal.lam * (s - cal.mu) - math.log(max(m, 1))
        tail = 0.0 if s <= 0 else x if x > 30 else -math.log(max(-math.expm1(-math.exp(-max(x, -5.0))), 1e-300))
        return 1 / (1 + math.exp(-cal.bias - cal.slope * min(tail, 12.0)))

    was, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for rows in ("7", was):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got.append({r.doc_id: (r.score, r.predicted) for r in toxicity.op10_toxicity(spark, d).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got[0] == got[1]
    assert all(abs(got[0][k][0] - score(*best[k])) < 1e-6 and got[0][k][1] == (score(*best[k]) >= 0.7) for k in best)
    assert got[0][502][1] == 1 and got[0][500][1] == 0


# 5. Fingerprints


def test_edited_texts_and_likeness(spark, odd_dir, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = spots.op5_fingerprints(spark, sf_dir).toPandas().set_index("doc_id")
    texts, ids = docs["text"].tolist(), docs["doc_id"].tolist()
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        n = len(t) // 4
        edited = t[: len(t) - n] + texts[(k + 1) % len(texts)][:n]
        assert got.loc[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got.loc[i].n_chars == len(t)
    assert got["near_edited"].mean() > 0.5 > 0.05 > got["near_next"].mean()
    same = collections.defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        same[t].add(got.loc[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_one_document_follows_itself(spark):
    one = spots.with_next(spark.createDataFrame([(5, "abc")], "doc_id long, text string"), ["text"]).collect()
    assert [(r.text, r.next_text) for r in one] == [("abc", "abc")]


def test_near_duplicate_texts_by_fingerprint(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text")
    sigs = {r.doc_id: set(r.s) for r in docs.select("doc_id", spots.signatures(F.col("text")).alias("s")).collect()}
    want = {(a, b) for a in sigs for b in sigs if a < b and (sigs[a] == sigs[b] or sigs[a] and sigs[b] and len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.8)}
    got = {r.doc_id: r.class_id for r in spots.near_classes(docs).collect()}
    parent = {i: i for i in sigs}
    for a, b in sorted(want):
        ra, rb = a, b
        while parent[ra] != ra:
            ra = parent[ra]
        while parent[rb] != rb:
            rb = parent[rb]
        parent[max(ra, rb)] = min(ra, rb)
    for i in sigs:
        r = i
        while parent[r] != r:
            r = parent[r]
        assert got[i] == r


def test_short_texts_are_no_copies_of_each_other(spark):
    rows = [(1, "This."), (2, "Ereaea."), (3, "this"), (4, "the"), (5, None), (6, "..."), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in spots.near_classes(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}


# 6. Lines


def test_line_dedup_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(lines.OP6_SQL).fetchall())
    got = lines.op6_line_dedup(spark, sf_dir).select("doc_id", "source", "text", "n_dropped").collect()
    assert sorted(tuple(r) for r in got) == want


def test_both_ways_of_the_line_join_agree(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "source", "text")
    a = sorted(map(tuple, lines.drop_boilerplate(docs).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert sorted(map(tuple, lines.drop_boilerplate(docs).collect())) == a


def test_pages_of_boilerplate_alone(spark):
    rows = [(k, "h", f"common\nown {k}" if k else "common\n") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_boilerplate(docs).collect()}
    assert got[0] == ("", 1) and got[3] == ("own 3", 1)
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_boilerplate(docs, keep_whole=True).collect()}
    assert got[0] == ("common\n", 0) and got[3] == ("own 3", 1)


def test_copies_make_no_boilerplate(spark):
    article = "first line\nsecond line\nthird line"
    rows = [(k, "h", article) for k in range(50)] + [(50, "h", article.replace("third", "other"))] + [(k, "h", f"own {k}\nmenu") for k in range(51, 151)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_boilerplate(docs).collect()}
    assert got[0] == (article, 0) and got[50] == (article.replace("third", "other"), 0) and got[60] == ("own 60", 1)


# 7. Near duplicates


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    h, w = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(1, 4, 300).astype(float)
    v = w.copy()
    v[:30], v[30:60] = 0, v[30:60] + 2
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    a, b = neardup.signature(h, w, 3000), neardup.signature(h[v > 0], v[v > 0], 3000)
    assert abs((a == b).mean() - want) < 0.03
    x, y = neardup.occurrences(h, w).tobytes(), neardup.occurrences(h[v > 0], v[v > 0]).tobytes()
    assert abs(neardup.similarity(x, y) - want) < 1e-9


def _classes(texts, least=0.8):
    sets = {i: set(neardup.occurrences(*neardup.shingles(t)).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (texts[a] == texts[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_classes_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == _classes(texts)


def test_large_groups_hold_together(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):  # near the base, hardly near each other
        t = list(base)
        for _ in range(4):
            t[rng.randrange(200)] = rng.choice(words)
        rows.append((k, " ".join(t)))
    rows += [(200 + k, rows[7][1]) for k in range(50)] + [(300 + k, " ".join(rng.choice(words) for _ in range(120))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _classes(dict(rows))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want
    monkeypatch.setattr(buckets, "HELD", 7)  # groups in many parts
    monkeypatch.setattr(buckets, "PASSED", 11)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want


def test_a_common_passage_links_only_what_is_near(spark, monkeypatch):
    """Texts of which half is one passage fall into the same buckets; chains and pairs among them are found, others are not."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(words) for _ in range(150)]
    texts = {}
    for k in range(60):
        texts[k] = passage + [rng.choice(words) for _ in range(60 + k % 5 * 10)]
    for k in range(60, 90):  # a chain, each near the one before
        t = list(texts[k - 1] if k > 60 else texts[3])
        at = rng.randrange(len(t) - 8)
        t[at : at + 6] = [rng.choice(words) for _ in range(6)]
        texts[k] = t
    texts = {k: " ".join(t) for k, t in texts.items()}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = _classes(texts)
    assert len(set(want.values())) < 65
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want
    monkeypatch.setattr(buckets, "HELD", 5)
    monkeypatch.setattr(buckets, "PASSED", 9)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want


def test_texts_of_one_node_are_told_apart(spark):
    def poor(text):
        return len(text) % 3, sum(text.encode())

    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "a b c d e f g"), (4, "one two three four five six seven"), (5, ""), (6, None), (7, "???")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), name=poor)
    assert {r.doc_id: r.class_id for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2001 + k) for k in range(60)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {i: root(i) for a, b in links if a != b for i in (a, b)}
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


# 8. Pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), pieces.PieceModel(pieces.model_bytes(pieces.default_model()))


def test_pieces_equal_the_library(library, spark, sf_dir):
    sp, m = library
    for r in spark.read.parquet(sf_dir + "/documents.parquet").select("text").collect():
        ids = m.encode(r.text)
        assert ids == sp.encode(r.text) and m.decode(ids) == r.text
    rng = random.Random(1)
    signs = list(" \n\t▁abcdetheéü漢字\U0001F600\x00<0x>AB  ..  ñçß")
    for _ in range(4000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        ids = sp.encode(t)
        assert m.encode(t) == ids and m.decode(ids) == sp.decode(ids)
    for _ in range(1500):
        ids = [rng.randrange(600) for _ in range(rng.randrange(12))]
        assert m.decode(ids) == sp.decode(ids)
    for t in ("a" * 20_000, " " * 77, "the" * 9000, "a" + " " * 33 + "b"):
        assert m.encode(t) == sp.encode(t)


def test_seam_rule_equals_re_merging(library):
    _, m = library
    rng = random.Random(4)
    names = sorted(m.reachable)
    for _ in range(4000):
        a, b = rng.choice(names), rng.choice(names)
        if not (a + b).startswith("▁▁") and "▁▁" not in a + b:
            assert m.compatible(m.ids[a], m.ids[b]) == (m.merge(a + b) == [a, b])


# 11. Whitening


def test_tiles_give_the_covariance(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (700, 37)) @ rng.integers(-2, 3, (37, 37))
    fit = spark.createDataFrame([([int(c) for c in r],) for r in x], "x array<long>").repartition(5)
    monkeypatch.setattr(whitening, "LEAST_TILE", 5)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 11)  # many row blocks, an odd last tile
    sums = whitening.dimension_sums(fit, 37)
    assert sums == x.sum(0).tolist()
    y = x - x.sum(0) / len(x)
    np.testing.assert_allclose(whitening.covariance(whitening.cut(fit), np.array(sums) / len(x), len(x)), y.T @ y / len(x), rtol=1e-12, atol=1e-6)


def test_sums_and_deviations_are_exact_beyond_a_long(spark):
    big = 2**61 + 12345
    fit = spark.createDataFrame([([big, -big],)] * 6 + [([3, -1],)], "x array<long>")
    assert whitening.dimension_sums(fit, 2) == [6 * big + 3, -6 * big - 1]
    m = whitening.Whitening(2, [3, 5], np.eye(2), np.ones(2), 2.0)
    assert m.deviations(np.array([[4, -1], [2**40, 7], [1, 2]])) == [25 + 49, None, 2]


def test_what_does_not_vary_is_null(spark, tmp_path):
    one = str(tmp_path / "one")
    spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>").write.parquet(one + "/embeddings.parquet")
    rows = whitening.op11_whitening(spark, one).collect()
    assert len(rows) == 4 and all(r.whitened is None and r.explained is None and r.identity_error == 0.0 and r.deviation == 0 and r.n == 1 for r in rows)
    line = str(tmp_path / "line")
    spark.createDataFrame([(k, [k / 8, k / 4]) for k in range(5)], "vec_id long, embedding array<double>").write.parquet(line + "/embeddings.parquet")
    rows = whitening.op11_whitening(spark, line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and rows[0].identity_error < 1e-9


# 12. Resampling


def _features(text, most):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def test_features_of_arrow_buffers():
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["a", "B", " ", "9", "é", "漢", "-", "\n", "\0", "[", "Z", "\U0001f600", "@", "~"]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice([*parts, "x" * rng.randint(1, 200)]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(8))]
        for kind in (pa.string(), pa.large_string()):
            for most in (1, 3):
                owner, bucket, words = resampling.features(pa.array(["head", *texts, "tail"], kind).slice(1, len(texts)), 10_000, most)
                want = [_features(t, most) for t in texts]
                assert words.tolist() == [len(w) for w, _ in want]
                assert [sorted(bucket[owner == k].tolist()) for k in range(len(texts))] == [sorted(zlib.crc32(f.encode()) % 10_000 for f in fs) for _, fs in want]


def test_a_word_of_millions_of_bytes_takes_few_steps():
    import pyarrow as pa

    long = "y" * 3_000_001
    began = time.perf_counter()
    _, bucket, words = resampling.features(pa.array(["ab " + long, long + " ab"]))
    assert time.perf_counter() - began < 15 and words.tolist() == [2, 2]
    assert sorted(bucket.tolist()) == sorted(2 * [zlib.crc32(b"ab") % 10_000, zlib.crc32(long.encode()) % 10_000])


def test_ranks_of_ties_and_repeated_rows(spark):
    rows = [(k % 7 if k % 11 else None, 5, k % 3) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(6)
    got = resampling.ranked(df, F.col("doc_id").isNull() | (F.col("doc_id") != 3), 50).collect()
    open_ = sorted((-s, i is None, i or 0) for i, _, s in rows if i != 3)
    want = collections.Counter((i if not none else None, -s, k + 1 if k < len(open_) // 2 else None) for k, (s, none, i) in enumerate(open_))
    assert collections.Counter((r.doc_id, r.score, r["rank"]) for r in got if r.doc_id != 3) == want
    assert all(r["rank"] is None for r in got if r.doc_id == 3) and len(got) == 100


# 13. Exact top-k


def _nearest(ids, x, k):
    out = []
    for i, q in enumerate(ids):
        if q is not None and q % 50 == 0:
            s = [int(sum(int(a) * int(b) for a, b in zip(x[i], y, strict=True))) for y in x]
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j] is None, ids[j] or 0))[:k]  # noqa: B023
            out += [(q, r + 1, ids[j], s[j]) for r, j in enumerate(order)]
    return collections.Counter(out)


@pytest.mark.parametrize("kind", ["ties", "clusters", "large"])
def test_nearest_by_pivots(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    n, d = 500, 3
    ids = [None if rng.random() < 0.05 else int(rng.integers(0, 40)) * 10 for _ in range(n)]
    if kind == "ties":
        x = rng.integers(-2, 3, (n, d))
    elif kind == "clusters":
        x = rng.integers(-400, 400, (8, d))[rng.integers(0, 8, n)] + rng.integers(-6, 7, (n, d))
    else:  # products beyond 2^53
        x = rng.integers(-(2**30), 2**30, (n, d))
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SLICE", 5)
    v = spark.createDataFrame([(i, [int(c) for c in y]) for i, y in zip(ids, x, strict=True)], "vec_id long, x array<long>")
    got = topk.nearest(v, d, F.col("vec_id") % 50 == 0, 4)
    assert collections.Counter(tuple(r) for r in got.collect()) == _nearest(ids, x, 4)


def test_bounds_spare_evaluations(spark):
    """In clusters most candidates are ruled out by their bounds, and none that belongs to the result."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 6))
    middle *= 3000 / np.linalg.norm(middle, axis=1)[:, None]  # as embeddings, of about one length
    x = (middle[rng.integers(0, 20, 4000)] + rng.integers(-20, 21, (4000, 6))).astype(np.int64)
    f = x.astype(float)
    pivots = f[rng.choice(4000, 24, replace=False)]
    t = topk.Table(pivots, float((f * f).sum(1).max()), 6, "int64", True)
    dist, seen = t.distances(f).T, 0
    count = t.products
    for q in range(0, 4000, 200):
        s = topk.Search(t, x[q], t.distances(f[q : q + 1], query=True)[0], 5)

        def counted(rows, query):
            nonlocal seen
            seen += len(rows)
            return count(rows, query)

        t.products = counted
        s.visit(x, dist, np.arange(4000), np.arange(4001))
        best = sorted(range(4000), key=lambda j: (-int(x[j] @ x[q]), j))[:5]  # noqa: B023
        assert s.ids.tolist() == best
    assert seen < 20 * 4000 / 3


def test_a_frequent_vector_is_one_candidate(spark):
    v = spark.createDataFrame([(k, [1, 2] if k % 3 else [k, 1]) for k in range(3000)], "vec_id long, x array<long>")
    got = topk.candidates(v, 6, F.col("vec_id") % 50 == 0).filter("x = array(1, 2)").collect()
    assert [r.ids for r in got] == [[1, 2, 4, 5, 7, 8]] and got[0].query
    rows = topk.nearest(v, 2, F.col("vec_id") % 50 == 0).collect()
    assert len(rows) == 60 * 5 and all(r.vec_id != r.query_id for r in rows)


def test_whole_numbers(spark):
    rows = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>, label int, x string, rank int")
    v, d = vectors.whole_vectors(rows)
    got = [(r.vec_id, r.x) for r in v.collect()]
    assert d == 2 and len(got) == 7 and (300, [-1, 192]) in got and (7, [0, 0]) in got and v.columns == ["vec_id", "x"]


def test_marks_rule_out_what_is_not_alike_and_nothing_else(spark):
    rng = random.Random(8)
    sets = [[rng.getrandbits(63) for _ in range(n)] for n in (1, 3, 20, 200, 200, 200, 215) for _ in range(8)]
    sets += [s[: len(s) - len(s) // 9] + [rng.getrandbits(63) for _ in range(len(s) // 9 - len(s) // 90)] for s in sets if len(s) > 9]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "node long, sigs array<long>").withColumns({"size": F.size("sigs"), **spots.marks()})
    groups = df.select(F.lit(2).alias("kind"), F.lit(7).cast("long").alias("g"), F.lit(0).alias("part"), F.lit(1).alias("side"), "node", F.col("node").alias("label"))
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and like(a, b) >= 0.8}
    stay = spots.near_members(groups.join(df.drop("sigs"), "node"), 0.8).select("node").distinct()
    assert want and {r.node for r in stay.collect()} == {i for i, _ in want}  # of 88 sets in one bucket only those with a partner are sent
    assert {(r.a, r.b) for r in spots._linked(groups, df, 0.8).collect()} == want
