"""Operators 11 to 13 against brute force, with parts, ranges and stripes so small that each way through is taken."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import divergence, nearest, spelling

DOCS = "doc_id long, text string, lang string, source string, word string, n int, part string, key string"
LONG = "abc def " * 40_000


def docs(spark, rows):
    """(doc_id, text, lang, source) with other columns, some of which are named as operators name theirs."""
    return spark.createDataFrame([(i, t, lang, s, "x", 1, "y", "z") for i, t, lang, s in rows], DOCS).repartition(3)


# 11


def near_by_force(words: dict[str, int]) -> dict[str, list[str]]:
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {a: sorted((b for b in words if b != a and near(a, b)), key=lambda b: (-words[b], b)) for a in words}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(alphabet="abÀ", min_size=1, max_size=6), st.integers(1, 9), min_size=1, max_size=60))
def test_a_part_finds_all_near_words_once(words):
    names = sorted(words)
    near = spelling.merge_part(names, [words[w] for w in names], set())
    want = near_by_force(words)
    assert {w: (near.found[w], near.best.get(w, (0, None))[1]) for w in names} == {w: (len(v), v[0] if v else None) for w, v in want.items()}


@pytest.mark.parametrize("part_words", [3, 16, 1 << 14])
def test_near_words_over_parts(spark, part_words):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abcé"), rng.integers(1, 6))): int(rng.integers(1, 9)) for _ in range(300)} | {"a" * 300: 4, "a" * 301: 9, "b" * 299 + "c": 1, "b" * 300: 2}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["near_n"], r["near_word"]) for r in spelling.near_words(table, part_words).collect()}
    assert got == {w: (words[w], len(v), words[v[0]] if v else None, v[0] if v else None) for w, v in near_by_force(words).items()}
    assert (len(spelling.shared_nodes(spelling.split_words(table, part_words))) > 1) == (part_words < 300)


def brute_variants(rows):
    words: Counter = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    near = near_by_force(words)
    form = {w: v[0] if v and words[v[0]] >= 2 * words[w] else None for w, v in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " 12 ,, é", None, None), (None, "Straße straßen " * 4, "de", "b"), (5, LONG, "en", "a"), (5, LONG, "en", "a"), (6, "x" * 70_000 + " " + "x" * 70_001, "", "b")]


@pytest.mark.parametrize("part_words", [4, 1 << 14])
def test_variants(spark, part_words):
    chain = [(10 + k, " ".join([f"wordy{'abcdef'[:k]}z"] * 3**k), "en", "s") for k in range(6)]
    rows = EDGE + chain * 2 + [(100 + i, f"colour color colours colouur Colour cölour {'naïve ' * (i % 5)}", "fr", "s") for i in range(97)]
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in spelling.variants(docs(spark, rows), part_words=part_words).collect())
    assert got == brute_variants(rows)
    assert any(form and root != form for _, form, root, *_ in got)


def test_no_words(spark):
    for rows in ([], [(1, None, "en", "a"), (2, "a bc", "en", "b")]):
        assert spelling.variants(docs(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs(spark, EDGE), ratio=1)


# 12


def brute_divergence(rows, least, best):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = {s: sum(count[lang, s][t] for t in kept) for s in sources}

        def p(n, of, v=len(kept)):
            return 1 + 1_000_000_000 * (n + 5) // (of + 5 * v)

        for s in sources:
            pairs = [(-sum(abs(p(count[lang, s][t], whole[s]) - p(count[lang, o][t], whole[o])) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(p(sum(count[lang, o][t] for o in sources), sum(whole.values())) - p(count[lang, s][t], whole[s]), t.encode()) for t in kept if count[lang, s][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(x for x in terms if x[0] < 0)[:best])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def divergence_rows():
    rng = np.random.default_rng(3)
    words = ["the", "Über", "straße", "日本", "日", "don", "t", "naïve", "a" * 80 + "b", "a" * 80 + "c", "zebra", "ze"]
    some = [(i, " ".join(rng.choice(words, rng.integers(0, 30))) + "-1's", ["en", "de", None][i % 3], [None, "s1", "s2", "ß", "s10"][int(rng.integers(0, 5))]) for i in range(150)]
    return EDGE + some + some[:20] + [(900, None, "xx", "only"), (901, "the the", "yy", "s"), (902, "", "yy", "t")]


@pytest.mark.parametrize("held, size, cells", [(1 << 23, 400_000, 1 << 22), (60, 9, 1 << 22), (25, 2, 7)])
def test_divergence(spark, held, size, cells):
    rows = divergence_rows()
    got = divergence.divergence(docs(spark, rows), least=4, best=3, held=held, size=size, cells=cells).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == brute_divergence(rows, 4, 3)


def test_pieces_are_handed_over_by_few(spark, monkeypatch):
    """A piece is about 0.1 MB: batches of as many as of short rows would grow with the input."""
    from cairn.llm import common

    rows = {}

    def noted(df, name, limit=common.BATCH_ROWS, write=common.stored_at):
        rows[name] = limit
        return write(df, name, limit)

    monkeypatch.setattr(common, "stored_at", noted)
    monkeypatch.setattr(divergence, "stored_at", lambda df, name, rows: noted(df, name, rows), raising=False)
    assert divergence.divergence(docs(spark, divergence_rows()), least=4, best=3, held=200, size=20).count() > 0
    assert all(rows[name] <= 64 for name in ("ranges", "kept", "met")) and rows["tries"] == common.BATCH_ROWS


def test_divergence_of_nothing(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0
    got = divergence.divergence(docs(spark, [(1, None, None, None), (2, "x", None, "s")])).collect()
    assert sorted((r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == [("", "pair", "s", 0, 1), ("s", "pair", "", 0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([97, 98, 122, 0x80, 0xC3, 0xFF]), min_size=1, max_size=5).map(bytes), st.integers(0, 2), st.integers(1, 9)), min_size=1, max_size=60), st.integers(1, 9))
def test_tries_round_trip_and_merge(leaves, size):
    def trie(part):
        texts = [b" ".join([term] * n) for term, _, n in part]
        groups = [("en", f"s{g}") for g in range(3)]
        return divergence.Trie.counted(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), np.array([g for _, g, _ in part]), groups)

    def leaf_counts(tries):
        out = Counter()
        for t in tries:
            terms = np.repeat(np.arange(len(t.terms)), t.fan)
            for i, g, n, d in zip(terms, t.grp, t.n, t.docs, strict=True):
                out[t.terms[i], t.groups[g]] += complex(n, d)
        return out

    def again(t):
        row = t.row()
        arrays = {k: np.array(row[k], dtype=object if k in ("langs", "sources") else None) for k in ("shared", "sizes", "fan", "langs", "sources", "grp", "n", "docs")}
        return divergence.Trie.read(row | arrays)

    halves = [t for part in (leaves[::2], leaves[1::2]) if part for t in trie(part).pieces(size)]
    whole = divergence.Trie.merged([again(t) for t in halves])
    assert whole.terms == sorted({t for t, _, _ in leaves})
    assert leaf_counts([whole]) == leaf_counts(halves) == leaf_counts([trie(leaves)])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**52), st.integers(1, 2**53))
def test_probability_is_exact(n, whole):
    n = min(n, whole)
    whole = whole + 5
    assert divergence.probability(np.array([n]), np.array([whole]))[0] == 1 + 1_000_000_000 * (n + 5) // whole


# 13

VECTORS = "vec_id long, embedding array<float>, label int, v int, dims string, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 0.5) for i, v in rows], VECTORS).repartition(3)


def brute_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            good[i] = min(good.get(i, v), v)
    out = []
    for i, q in good.items():
        if i % 20 == 0:
            found = []
            for j, c in good.items():
                if j != i and len(c) == len(q):
                    score = 0.0
                    for a, b in zip(q, c, strict=True):
                        score += a * b
                    found.append((-score, j))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(9)
    some = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(300)]
    copies = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300, 420)]
    close = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0 + i * 1e-6]) for i in range(420, 500)]
    odd = [(500, None), (520, []), (540, [0.0] * 6), (560, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (580, [float("nan")] * 6), (600, [float("inf")] * 6), (None, [1.0] * 6)]
    return some + copies + close + odd + [(620, [1.0, 1.0]), (621, [2.0, 2.0]), (640, [1.0]), (40, [9.0] * 6), (41, [1.0] * 6), (41, [1.0] * 6), (660, [1e-42] * 6), (680, [3e38] * 6)]


@pytest.mark.parametrize("settings_", [{}, {"stripe_bytes": 300, "stream_rows": 50}])
def test_nearest(spark, settings_):
    rows = vector_rows()
    got = sorted(tuple(r) for r in nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, **settings_).collect())
    assert got == brute_nearest(rows, 20)


def test_nearest_of_few_and_none(spark):
    asks = F.col("vec_id") % 20 == 0
    assert nearest.nearest(vectors(spark, []), asks).count() == 0
    assert nearest.nearest(vectors(spark, [(1, [1.0, 1.0])]), asks).count() == 0
    assert nearest.nearest(vectors(spark, [(20, [1.0, 1.0])]), asks).count() == 0
    assert [tuple(r) for r in nearest.nearest(vectors(spark, [(20, [1.0, 1.0]), (3, [-1.0, 0.5])]), asks).collect()] == [(20, 1, 3, -0.5)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 64, 1500]))
def test_bounds_hold(seed, dims):
    rng = np.random.default_rng(seed)
    q, c = (nearest.Coded(np.arange(5), rng.standard_normal((5, dims)) * 10.0 ** rng.integers(-20, 20, (5, 1))) for _ in range(2))
    product = nearest.coded_products(q, c) * q.scale[:, None] * c.scale
    error = q.rest[:, None] * (c.length + c.rest) + q.length[:, None] * c.rest + 1e-12 * q.length[:, None] * c.length
    assert (np.abs(product - q.x @ c.x.T) <= error).all()


def test_a_tile_of_close_vectors(spark):
    """More rows than one tile, nearly all of which survive the 8-bit bounds."""
    rng = np.random.default_rng(2)
    x = np.ones((2500, 8)) + 1e-4 * rng.standard_normal((2500, 8))
    heaps = nearest.Heaps(nearest.Coded(np.arange(0, 2500, 20), x[::20]), 20)
    heaps.add(nearest.Coded(np.arange(2500), x))
    scores = x[::20] @ x.T
    for i, heap in enumerate(heaps.heaps):
        order = [j for j in np.lexsort((np.arange(2500), -scores[i])) if j != 20 * i][:20]
        assert sorted(-j for _, j in heap) == sorted(order)
