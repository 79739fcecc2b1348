"""Queries and the pipeline against plain Python over a whole small table."""

import collections
import hashlib
import html.parser
import itertools
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest

from pointframe.llm import language, lines, neardup, pages, pieces, quality, resampling, secrets, spots, tiling, topk, whitening

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return spark.read.parquet(sf_dir + "/documents.parquet").orderBy("doc_id").collect()


def test_secrets_digests(spark, sf_dir, rows):
    got = {r.doc_id: r for r in secrets.op2_secrets(spark, sf_dir).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = 0
    for r in rows:
        t = r.text or ""
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        spans = [f"{k}:{s}:{e}" for s, _, k, e in sorted(base)]
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(b[2] == k for b in base) for k in ("assign", "access", "hex"))
        assert g.base_sha256 == SHA(",".join(spans)) and set(spans) <= set(g.spans.split(","))
        assert [x for x in g.spans.split(",") if x and not x.startswith("literal")] == spans
        found += len(spans)
    assert found > 3


def test_piece_digests(spark, sf_dir, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r for r in pieces.op8_sentencepiece(spark, sf_dir).collect()}
    for r in rows:
        ids = sp.encode(r.text or "", add_eos=True)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), SHA(" ".join(map(str, ids))), SHA(sp.decode(ids)))


def _signatures(text):
    """Chains of two content words after an anchor or the start of a line or sentence, as texts."""
    anchors, every = set(spots.ANCHORS), re.findall(r"[^\W_]+", text.lower())
    flat = list(itertools.chain.from_iterable(["\x01", *("\x01" if w in anchors else w for w in re.findall(r"[^\W_]+", p))] for p in re.split(r"[\n.!?|;]+", text.lower())))
    marks = [k for k, w in enumerate(flat) if w == "\x01" and k + 1 < len(flat) and flat[k + 1] != "\x01"]
    chains = set()
    for k in marks:
        after = [w for w in flat[k + 1 :] if w != "\x01"][:2]
        gap = flat[k + 2] if k + 2 < len(flat) else None
        if len(after) == 2 and (gap != "\x01" or k + 3 < len(flat)):
            chains.add(tuple(after))
    return chains or ({tuple(every)} if every else set())


def test_likeness_of_fingerprints(spark, sf_dir, rows):
    got = {r.doc_id: r for r in spots.op5_fingerprints(spark, sf_dir).collect()}
    texts = [r.text or "" for r in rows]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = collections.defaultdict(set)
    for k, r in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = _signatures(t), _signatures(edited), _signatures(after)
        g = got[r.doc_id]
        assert g.n_chars == len(t) and g.edited_sha256 == SHA(edited)
        assert abs(g.near_edited - like(a, b)) < 1e-9 and abs(g.near_next - like(a, c)) < 1e-9
        prints[g.fingerprint].add(frozenset(a))
        prints[g.edited_fingerprint].add(frozenset(b))
    assert all(len(x) == 1 for x in prints.values()) and len({x for s in prints.values() for x in s}) == len(prints)


def test_quality_scores(spark, sf_dir, rows):
    """Covariances, inverses and determinants written out, and the logistic fitted by plain steps."""
    got = {r.doc_id: r for r in quality.op4_quality(spark, sf_dir).collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(sf_dir + "/labels.parquet").collect() if r.quality is not None}
    x = {r.doc_id: np.array(quality.statistics(r.text or "")) for r in rows}
    fit = [k for k in x if k in y and zlib.crc32(str(k).encode()) % 3 != 1]
    m, lab = np.array([x[k] for k in fit]), np.array([y[k] for k in fit])
    scale = lambda v: np.clip((v - m.mean(0)) / np.maximum(m.std(0), 1e-6), -8, 8)
    z, d = scale(m), m.shape[1]
    within = [z[lab == c] - z[lab == c].mean(0) for c in (0, 1)]
    pool = sum(w.T @ w for w in within) / len(z)
    density = []
    for c in (0, 1):
        cov = (within[c].T @ within[c] + 10 * pool) / (len(within[c]) + 10)
        cov = 0.9 * cov + 0.1 * pool
        cov = 0.98 * cov + 0.02 * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        density.append((z[lab == c].mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], math.log((lab == c).mean())))
    logs = lambda v: [p - 0.5 * ((v - mu) * ((v - mu) @ inv)).sum(-1) - 0.5 * det for mu, inv, det, p in density]
    margin = lambda v: logs(v)[1] - logs(v)[0]
    v, b = np.clip(margin(z), -30, 30), np.array([0.3, 0.0])
    loss = lambda b: np.logaddexp(0, -(2 * lab - 1) * (b[0] * v + b[1])).sum() + 0.05 * ((b - [0.3, 0.0]) ** 2).sum()
    for k in np.geomspace(0.3, 1e-7, 60):  # a pattern search
        for step in [(k, 0), (-k, 0), (0, k), (0, -k)] * 6:
            b = b + step if loss(b + step) < loss(b) else b
    for k, g in got.items():
        want = 1 / (1 + np.exp(-np.clip(b[0] * margin(scale(x[k])) + b[1], -40, 40)))
        assert abs(g.score - want) < 1e-3 and g.predicted == (g.score >= 0.5), (k, g.score, want)


def _grams(text):
    """Buckets of the grams of one to three code points of a text, those without a letter left out."""
    c = [ord(x) if x.isalpha() else 0 for x in text.lower()] + [0, 0, 0]
    out, m = [], (1 << 32) - 1
    for k in range(len(c)):
        h = c[k] * 0x9E3779B1 & m
        for n in (1, 2, 3):
            if k + n > len(c):
                break
            if n > 1:
                h = (h * 0x85EBCA6B + c[k + n - 1] * 0xC2B2AE35 + n) & m
            if any(c[k : k + n]):
                out.append((h ^ (h >> (15 if n == 1 else 13))) % language.BUCKETS)
    return out


def _languages(docs):
    """doc_id to (language, score) by codewords, for rows (doc_id, text, lang)."""
    grams = [_grams(r.text or "") for r in docs]
    count = collections.defaultdict(collections.Counter)
    for r, g in zip(docs, grams, strict=True):
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            count[r.lang].update(g)
    langs = sorted(count)
    codes = np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=len(langs) - 1)][1:]).T
    share = np.array([[count[x][b] + 0.5 for b in range(language.BUCKETS)] for x in langs])
    share /= share.sum(1, keepdims=True)
    odds = [np.log(share[codes[:, b] > 0].mean(0)) - np.log(share[codes[:, b] < 0].mean(0)) for b in range(codes.shape[1])]
    trust = np.array([max((share @ o * codes[:, b]).min(), 1e-3) for b, o in enumerate(odds)])
    trust /= trust.mean()
    out = {}
    for r, g in zip(docs, grams, strict=True):
        margin = np.array([o[g].sum() / (len(g) + language.FEW) for o in odds])
        loss = np.array([(np.logaddexp(0, -language.SHARPNESS * margin * c) * trust).sum() / trust.sum() for c in codes])
        p = np.exp(-(loss - loss.min()) * len(trust))
        letters = any(x.isalpha() for x in (r.text or "").lower())
        gap = np.sort(loss)[1] - loss.min()
        out[r.doc_id] = (langs[int(loss.argmin())], 1 / p.sum(), gap < language.AMBIGUOUS) if letters else (language.UND, 0.0, True)
    return out


def test_language_scores(spark, sf_dir, rows):
    want = _languages(rows)
    for r in language.op9_language_id(spark, sf_dir).collect():
        lang, score, ambiguous = want[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3 and r.ambiguous == ambiguous


def _covered(doc, item):
    """The share of an item that greedy tiles of five tokens or more cover."""
    fd, fi, least, done = [True] * len(doc), [True] * len(item), min(5, len(item)), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and fd[d + k] and fi[i + k] and doc[d + k] == item[i + k]:
                    k += 1
                best = max(best, (k, -i, -d))
        k, i, d = best[0], -best[1], -best[2]
        if k < least:
            return done / len(item)
        done += k
        fd[d : d + k], fi[i : i + k] = [False] * k, [False] * k


def test_pipeline(spark, sf_dir, rows):
    # Languages.
    told = _languages(rows)
    docs = {r.doc_id: [r.text or "", r.source] for r in rows if told[r.doc_id][0] != "und" and not (told[r.doc_id][2] and told[r.doc_id][1] < 0.5)}
    # Lines: pages of one text in a source count once.
    pages = {(s, t) for t, s in docs.values() if s is not None}
    total = collections.Counter(s for s, _ in pages)
    on = collections.Counter((s, x) for s, t in pages for x in set(t.split("\n")) if x)
    bad = {k for k, n in on.items() if n >= lines.MIN_PAGES and n > lines.MAX_RATIO * total[k[0]]}
    docs = {k: "\n".join(x for x in t.split("\n") if (s, x) not in bad) for k, (t, s) in docs.items()}
    assert bad
    # Near duplicates: the least id of a chain of similar ones.
    bags = {}
    for k, t in docs.items():
        w = re.findall(r"\w+", t.lower())
        n = min(neardup.WORDS, len(w))
        bags[k] = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()
    parent = {k: k for k in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = bags[a], bags[b]
        both = sum((x & y).values())
        if docs[a] == docs[b] or x and y and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = {k: t for k, t in docs.items() if root(k) == k}
    # Benchmark passages: a tile needs five tokens in common.
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [tokens(r.text or "") for r in spark.read.parquet(sf_dir + "/benchmark.parquet").collect()]
    seeds = [{tuple(i[k : k + 5]) for k in range(max(1, len(i) - 4))} for i in items]
    clean = {}
    for k, t in docs.items():
        w = tokens(t)
        have = {tuple(w[j : j + n]) for n in {5, *(len(i) for i in items if len(i) < 5)} for j in range(len(w))}
        if not any(i and s & have and _covered(w, i) >= 0.5 for i, s in zip(items, seeds, strict=True)):
            clean[k] = t
    assert len(clean) < len(docs) < len(rows)
    # Pieces.
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == clean
    assert all(list(r.ids) == sp.encode(r.text, add_eos=True) for r in got)


def test_whitening_by_numpy(spark, sf_dir):
    e = spark.read.parquet(sf_dir + "/embeddings.parquet").collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(np.int64) for r in e}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    v = y.T @ y / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:4], vecs[:, ::-1][:, :4]
    got = collections.defaultdict(dict)
    for r in whitening.op11_whitening(spark, sf_dir).collect():
        got[r.vec_id][r.component] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum()) and r.identity_error < 1e-10
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-12
    have = np.array([[got[i][c] for c in (1, 2, 3, 4)] for i in x])
    want = np.array([(x[i] - s / n) @ vecs / np.sqrt(values) for i in x])
    np.testing.assert_allclose(have, want * np.sign((have * want).sum(0)), atol=1e-8)


def test_resampling_by_words(spark, sf_dir, rows):
    def buckets(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]

    docs = {r.doc_id: buckets(r.text) for r in rows}
    s, t = collections.Counter(b for v in docs.values() for b in v), collections.Counter()
    for r in spark.read.parquet(sf_dir + "/benchmark.parquet").collect():
        t.update(buckets(r.text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = {}
    for i, v in docs.items():
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, v))
        want[i] = [len(v), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((i for i in want if want[i][0] >= 20), key=lambda i: (-want[i][2], i))
    for k, i in enumerate(order[: 10 * len(order) // 100]):
        want[i][3] = k + 1
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in resampling.op12_resampling(spark, sf_dir).collect()} == want


def test_topk_by_all_products(spark, sf_dir):
    e = spark.read.parquet(sf_dir + "/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in e], np.floor(256 * np.array([r.embedding for r in e], float)).astype(np.int64)
    want = set()
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = x @ x[i]
            want |= {(q, k + 1, ids[j], int(s[j])) for k, j in enumerate(sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:5])}  # noqa: B023
    assert {tuple(r) for r in topk.op13_topk(spark, sf_dir).collect()} == want


class _Article(html.parser.HTMLParser):
    """The texts of the blocks of a page's article element, but for its adverts and forms."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.now = [], [], ""

    def _end(self):
        if self.now.split():
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        if tag in ("br", "meta", "img", "input", "link", "hr"):
            self.now += " "
            return
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self._end()
        if tag == "p" and "p" in self.open:
            self.open = self.open[: self.open.index("p")]
        self.open.append("out" if tag in ("aside", "form", "script", "style", "nav", "footer") or {"ad", "comments", "cookie"} & set(names) else tag)
        self.open[-1] = self.open[-1] if self.open[-1] == "out" else tag

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self._end()
        if tag in self.open:
            k = len(self.open) - 1 - self.open[::-1].index(tag)
            self.open = self.open[:k]
        elif "out" in self.open and tag in ("aside", "form", "script", "style", "nav", "footer", "div"):
            self.open = self.open[: len(self.open) - 1 - self.open[::-1].index("out")]

    def handle_data(self, data):
        if "article" in self.open and "out" not in self.open:
            self.now += data


def test_main_text_by_the_article_element(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(sf_dir + "/pages.parquet").collect():
        p = _Article()
        p.feed(r.html or "")
        p._end()
        want[r.page_id] = "\n".join(p.out)
    got = {r.page_id: r for r in pages.op3_main_text(spark, sf_dir).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values()) and any(want.values())


def test_contaminations_by_naive_tiles(spark, sf_dir, rows):
    from test_text_operators import _naive_tiles

    items = {r.item_id: tiling.tokens(r.text or "") for r in spark.read.parquet(sf_dir + "/benchmark.parquet").collect()}
    grams = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    want = {}
    for r in rows:
        doc = tiling.tokens(r.text or "")
        have = grams(doc, tiling.SEED)
        for i, item in items.items():
            least = min(tiling.SEED, len(item))
            if item and (have & grams(item, tiling.SEED) if least == tiling.SEED else grams(doc, least) & grams(item, least)):
                tiles = _naive_tiles(doc, item, tiling.SEED)
                covered = sum(k for _, _, k in tiles)
                if covered >= tiling.COVERAGE * len(item):
                    want[r.doc_id, i] = (round(covered / len(item), 9), len(tiles), covered)
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_tiles, r.n_tokens) for r in tiling.op1_decontamination(spark, sf_dir).collect()}
    assert got == want and want
