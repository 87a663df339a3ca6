"""Operators against brute force on small tables, and on rows that are null, empty, long, repeated or missing."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import chat_format, components, decontaminate, embedding_dedup, jaccard_join, language_id, language_model, mixing, quality, queries, simple8b, textvec, token_counts, token_output

DOCS = "doc_id long, text string, lang string, source string, score double, n int, bucket string"
LONG = "abc def " * 40_000


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name]) == ""


def docs(spark, rows):
    """(doc_id, text) with other columns, some of which are named as operators name theirs."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 3 else None, 0.5, 1, "x") for i, t in rows], DOCS)


EDGE = [(1, "the cat sat on the mat and the dog"), (2, None), (3, ""), (4, " \t\n"), (5, "the cat sat on the mat and the dog"), (6, LONG), (7, "!!! 123"), (8, "Ünï çødé ßtring"), (8, "Ünï çødé ßtring"), (9, "x")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(2**59, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    packed, offsets = simple8b.encode(x)
    assert (simple8b.decode(packed, offsets, len(x)) == x).all()
    assert len(offsets) == -(-len(x) // simple8b.BLOCK)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b.日", max_size=40)), max_size=12), st.integers(1, 60))
def test_words_and_windows(texts, limit):
    got, shingles = [], []
    for c in textvec.chunks(pa.array(texts, pa.string()), limit):
        w = textvec.words(c)
        lower = textvec.lowered(c.data).tobytes()
        for a, b in zip(w.of[:-1], w.of[1:], strict=True):
            got.append([lower[x:y].decode() for x, y in zip(w.start[a:b], w.end[a:b], strict=True)])
        h, at = textvec.windows(w.hash, w.of, 3)
        shingles += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    want = [words(t) for t in texts]
    assert got == want
    grams = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else []) for w in want]
    assert [len(x) for x in shingles] == [len(g) for g in grams]
    same: dict = {}
    for hs, gs in zip(shingles, grams, strict=True):
        for h, g in zip(hs.tolist(), gs, strict=True):
            assert same.setdefault(g, h) == h
    assert len(set(same.values())) == len(same)


# 1


def test_language_of_edge_rows(spark):
    learn = spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in ((f"the house and the tree {i}", "en"), (f"das Haus und der Baum {i}", "de"))], "doc_id long, text string, lang string")
    model = language_id.train(learn)
    got = {r["doc_id"]: r for r in language_id.predict(docs(spark, EDGE), model).collect()}
    assert got[1]["lang_pred"] == "en" and 0 < got[1]["score"] <= 1
    near = language_id.predict(docs(spark, [(1, "das Haus und der Baum 99")]), model).first()
    assert near["lang_pred"] == "de" and not near["rejected"]
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {2, 3, 4, 7}
    assert got[2]["score"] == 0 and got[8]["lang_pred"] in ("en", "de")
    far = language_id.predict(docs(spark, [(1, "zzqx kkvw qqjz")]), model).first()
    assert far["rejected"]
    nothing = language_id.train(learn.limit(0))
    assert language_id.predict(docs(spark, EDGE), nothing).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(docs(spark, []), model).count() == 0


def test_language_equals_brute_force(spark):
    """Vectors, document frequencies and cosines written out gram by gram; centroids as the means of what is nearest to them."""
    learn = [(i, f"{t} {i}", lang) for i in range(40) for t, lang in (("The house AND the tree", "en"), ("das Haus  und der Baum", "de"), ("la maison, et l'arbre", "fr"))]
    model = language_id.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"), k=2)

    def vector(text):
        data = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0x20 for b in text.encode())
        n: Counter = Counter()
        for k in (2, 3):
            for i in range(len(data) - k + 1):
                gram = data[i : i + k]
                if b"  " not in gram:
                    n[((int.from_bytes(gram, "little") + k) * 0x9E3779B1 % 2**32 >> (32 - language_id.BITS)) + ((k - 2) << language_id.BITS)] += 1
        return {g: np.log1p(c) for g, c in n.items()}

    df: Counter = Counter(g for _, t, _ in learn for g in vector(t))
    idf = {g: np.log((1 + len(learn)) / (1 + df[g])) + 1 for g in range(language_id.WIDTH)}
    assert np.allclose(model["idf"], [idf[g] for g in range(language_id.WIDTH)], rtol=1e-5)

    def unit(text):
        out = np.zeros(language_id.WIDTH)
        for g, v in vector(text).items():
            out[g] = v * idf[g]
        return out / (np.linalg.norm(out) or 1)

    assert len(model["centres"]) == 6 and model["langs"] == ["de", "en", "fr"]
    for at, lang in enumerate(model["langs"]):
        mine, centres = np.array([unit(t) for _, t, x in learn if x == lang]), model["centres"][model["owner"] == at]
        near = (mine @ centres.T).argmax(1)
        for j in set(near.tolist()):
            mean = mine[near == j].sum(0)
            assert mean / np.linalg.norm(mean) @ centres[j] > 0.9999
    asked = [(i, t) for i, t in EDGE] + [(50, "le chat ET la souris"), (51, "der Hund und das"), (52, "the tree of a house")]
    for r in language_id.predict(docs(spark, asked), model).collect():
        text = dict(asked)[r["doc_id"]] or ""
        cosines = model["centres"] @ unit(text)
        best = int(cosines.argmax())
        if any(c.isalpha() for c in text):
            assert abs(r["score"] - np.clip(cosines[best], 0, 1)) < 1e-4
            assert r["lang_pred"] == model["langs"][model["owner"][best]] or abs(cosines[best] - max(cosines[model["owner"] == model["langs"].index(r["lang_pred"])])) < 1e-5
            assert r["rejected"] == (r["score"] < model["floor"][model["langs"].index(r["lang_pred"])])
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_language_held_out(spark, sf_dir):
    rows = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


# 2, 5-word pipeline stage


def brute_components(rows, width, num):
    sets: dict = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= num * len(x | y):
                            p, q = find(a), find(b)
                            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, {i: max(map(len, s)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, width, num):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghij"), 60) + rng.choice(list("klmnopq"), 60)) for _ in range(6)]
    rows = [*EDGE[:8], (9, "x")]
    for k in range(60):
        w = base[k % 6].split()
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"edit{rng.integers(0, 5)}"
        rows.append((100 + k, " ".join(w[: rng.integers(100, 121)])))
    want, sizes = brute_components(rows, width, num)
    got = jaccard_join.jaccard_join(docs(spark, rows), width, num, 100).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert len(set(want.values())) < len(want) - 5


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0
    got = jaccard_join.jaccard_join(docs(spark, [(1, None), (2, ""), (None, "a b c")])).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(1, 0, 1), (2, 0, 2), (None, 1, None)}


def test_large_group_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = [(i, " ".join([f"w{j}" for j in range(40)] + [f"own{i % 70}"])) for i in range(120)]
    want, _ = brute_components(rows, 3, 90)
    got = jaccard_join.jaccard_join(docs(spark, rows), 3, 90, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_chance_meetings_cost_no_links(spark, monkeypatch):
    """With few routing bits unlike sets share clusters of many blocks; the result is the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "_half", lambda hashes: (hashes & np.uint64(15)).astype(np.uint32))
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 60)))) for i in range(120)]
    rows += [(1000 + i, t.rsplit(" ", 1)[0]) for i, t in rows[::3]]
    want, _ = brute_components(rows, 3, 90)
    got = jaccard_join.jaccard_join(docs(spark, rows), 3, 90, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 10 < len(set(want.values())) < len(rows)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_tree_finds_what_all_pairs_find(seed):
    rng = np.random.default_rng(seed)
    core = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(core, rng.integers(40, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])) for _ in range(40)]
    cut = int(rng.integers(0, 40))

    def classes(pairs, n):
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        x, y = components.forest(np.maximum(a, b), np.minimum(a, b))
        return dict(zip(x.tolist(), y.tolist(), strict=True))

    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    every = [(i, j) for i in range(40) for j in range(i + 1, 40) if linked(sets[i], sets[j])]
    assert classes(jaccard_join.tree_links(sets, None, 75, 100), 40) == classes(every, 40)
    across = [(i, j) for i, j in every if i < cut <= j]
    assert classes(jaccard_join.tree_links(sets[:cut], sets[cut:], 75, 100), 40) == classes(across, 40)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# 3


def test_token_output_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [*EDGE, (10, "don't <|endoftext|> <|ENDOFTEXT|> a.b'c  É é word,"), (None, "null id"), (-(2**63), "the least id"), (11, "x" * 90_000 + "-" * 50_000)]
    got = token_output.token_output(docs(spark, rows).repartition(3), path).orderBy("start").collect()
    tok, start = Tokenizer.from_file(path), 0
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    text = dict(rows)
    for r in got:
        ids = [*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.token_output(docs(spark, []), path).count() == 0


# 4


ITEM = "Yesterday in town Anna sold 12 kg of flour to Peter, and later Anna bought 7 kg back from him"


def brute_contaminated(documents, items, width=8):
    """Items found whole in plain form."""
    clean = lambda t: re.sub(r"[^\w]+", " ", (t or "").lower()).strip()
    return {(i, j) for i, t in documents for j, b in items if len(clean(b).split()) >= width and f" {clean(b)} " in f" {clean(t)} "}


def test_decontamination(spark):
    other = "a quick study of rivers shows that slow water carries less sand than fast water does"
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, None), (4, "too short"), (1, ITEM), (5, "")], "item_id long, text string")
    rows = [
        (10, "x. " + ITEM + " end"), (11, ITEM.upper()), (12, ITEM.replace("Anna", "Maria").replace("12", "15").replace("Peter", "Robert").replace("7", "9")),
        (13, ITEM.replace("Anna", "Maria", 1).replace("Anna", "Julia").replace("12", "15").replace("Peter", "Robert").replace("7", "9")), (14, None), (15, ""), (16, other), (16, other), (17, "nothing of the kind"), (18, "a quick study of rivers shows"), (None, other),
    ]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(10, 1): False, (11, 1): False, (12, 1): True, (16, 2): False, (None, 2): False}
    kept = decontaminate.without_contaminated(docs(spark, rows), items)
    assert {13, 14, 15, 17, 18} <= {r["doc_id"] for r in kept.collect()} and kept.columns == docs(spark, []).columns
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), items.limit(0)).count() == 0


def test_decontamination_of_short_and_dense_items(spark):
    texts = ["What is 17 times 23?", "Who wrote Hamlet?", "Solve for x: 3x + 7 = 22.", "Compute 12 + 7 * 3 - 4 + 18 / 6 - 2 * 5 + 9.", "The Old Man Reads A Very Long Book In The Garden", "7"]
    items = spark.createDataFrame(list(enumerate(texts[:5])) + [(8, " .!"), (9, None)], "item_id long, text string")
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, f"before it, {t.lower()} And after it.") for i, t in enumerate(texts)] + [(20, "What is 18 times 23?"), (21, "wrote Hamlet"), (22, ""), (23, None), (24, "?!")]
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(i, i % 10, False) for i in (0, 1, 2, 3, 4, 10, 11, 12, 13, 14)}


def test_decontamination_of_names_that_open_sentences(spark):
    texts = [
        "Mary has 12 apples. Mary gives 4 apples to John. John eats 2 apples. How many apples does Mary have?",
        "Ken bought 7 books. Ken sold 3 books. Sue bought 5 books.\nSue lost 2 books. How many books are left?",
        "Bob has 3 red pens. Amy has 9 blue pens. Bob gives Amy 2 pens. How many pens does each of them have?",
    ]
    new = {"Mary": "Julia", "John": "Peter", "Ken": "Tom", "Sue": "Ida", "Bob": "Max", "Amy": "Eva", "12": "15", "4": "6", "2": "8", "7": "11", "3": "1", "5": "10", "9": "14"}
    other = [re.sub(r"\w+", lambda m: new.get(m[0], m[0]), t) for t in texts]
    mixed = [re.sub(r"\w+", lambda m: new.get(m[0], m[0]) if m.start() % 3 else m[0], t.replace("Mary", "Julia", 1)) for t in texts[:1]]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = list(enumerate(texts)) + [(10 + i, t) for i, t in enumerate(other)] + [(20, mixed[0]), (31, texts[1].title()), (32, other[0].replace("apples", "pears"))]
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(0, 0, False), (1, 1, False), (2, 2, False), (10, 0, True), (11, 1, True), (12, 2, True), (31, 1, False)}


def brute_templates(documents, items, width=8, least=5, coverage=0.5, run=6):
    """(doc_id, item_id, n_matched, n_windows, reparameterised) by comparing every window of every document, slots included."""
    import regex

    number_words = set(decontaminate.NUMBERS)

    def canonical(text):
        t = regex.sub("[\x01-\x04]", " ", text or "")
        t = regex.sub(r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+", lambda m: "\x01" + m[0], t)
        t = regex.sub("(?<![\\p{L}\\p{N}\x01])\\p{Lu}\\p{Ll}+", lambda m: "\x04" + m[0], t)
        if regex.search("[0-9]", text or ""):
            t = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t)
            t = regex.sub(r"(?<![\p{L}0-9])[0-9]+", lambda m: " \x02" + m[0] + " ", t)
            t = regex.sub(f"(\x02[0-9]+ +)\x04?((?i:{decontaminate.UNITS}))(?![\\p{{L}}0-9])", lambda m: m[1] + "\x03" + m[2], t)
        return regex.sub(r"[^\p{L}\p{N}\x01-\x04]+", " ", t).lower().strip(" ").split(" ")

    plain = lambda w: w.lstrip("\x01\x02\x03\x04")

    def kind(w):
        return "\x02" if plain(w) in number_words else {"\x04": "\x01"}.get(w[0], w[0])

    def slot(w, wide):
        return plain(w) in number_words or w[:1] in (("\x01", "\x02", "\x03", "\x04") if wide else ("\x01", "\x02", "\x03")) or w == ""

    def template(ws, wide):
        return tuple(kind(w) if slot(w, wide) else plain(w) for w in ws)

    known: dict = {}
    for item, ws in {(i, tuple(canonical(t))) for i, t in items}:
        if not any(ws):
            continue
        windows = []
        for k in range(max(len(ws) - width + 1, 1)):
            size = min(width, len(ws) - k)
            own = ws[k : k + size]
            solid = [j for j in range(k, len(ws)) if not slot(ws[j], True)]
            within = sum(j < k + size for j in solid)
            span = size if within >= least else solid[least - 1] - k + 1 if within and len(solid) >= least else None
            windows.append((k, size, span, sum(not slot(w, False) for w in own) >= least))
        n = {"plain": len(windows), "template": sum(w[3] for w in windows), "wide": sum(w[2] is not None for w in windows)}
        for k, size, span, has in windows:
            entry = (item, ws, k, size, span, has, tuple(n.items()))
            for form, length, ok in (("plain", size, True), ("template", size, has), ("wide", span, span is not None)):
                if ok:
                    text = tuple(map(plain, ws[k : k + length])) if form == "plain" else template(ws[k : k + length], form == "wide")
                    known.setdefault((form, length), {}).setdefault(text, []).append(entry)
    out: dict = {}
    for doc, text in {(i, t or "") for i, t in documents}:
        dw, met = canonical(text), {}
        for (form, length), table in known.items():
            for at in range(len(dw) - length + 1):
                own = dw[at : at + length]
                for entry in table.get(tuple(map(plain, own)) if form == "plain" else template(own, form == "wide"), []):
                    if at + entry[3] <= len(dw):
                        met.setdefault((entry, at), set()).add(form)
        aligned: dict = {}
        for ((item, ws, k, size, span, has, n), at), forms in met.items():
            for form, on in (("template", has and forms & {"template", "plain"}), ("wide", "wide" in forms or span is not None and "plain" in forms), ("plain", "plain" in forms)):
                if not on:
                    continue
                length = span if form == "wide" and "wide" in forms else size
                pairs = {(kind(a) + plain(a), kind(a) + plain(b)) for a, b in zip(ws[k : k + length], dw[at : at + length], strict=False) if form != "plain" and slot(a, form == "wide")}
                a = aligned.setdefault((item, ws, form, dict(n)[form]), {}).setdefault(at - k, (set(), set(), set()))
                a[0].add(k)
                a[1].update({k} if "plain" in forms else ())
                a[2].update(pairs)
        for (item, _, form, n), shifts in aligned.items():
            ks, plain_ks, changed = set(), set(), []
            for windows, plains, pairs in shifts.values():
                named = [p for p in pairs if p[0][0] != "\x02"]
                sound = len({a for a, _ in pairs}) == len(pairs) and len({b for _, b in named}) == len(named)
                ks |= windows if sound else plains
                plain_ks |= plains
                if form != "plain":
                    changed.append(any(a != b for a, b in pairs))
            if len(ks) >= coverage * n or len(plain_ks) >= run:
                share, all_changed = out.get((doc, item), ((0, 0, 0), []))
                out[doc, item] = max(share, (len(ks) / n, len(ks), n)), all_changed + ([min(changed)] if changed else [])
    return {(d, i, share[1], share[2], min(c) if c else False) for (d, i), (share, c) in out.items()}


def found_rows(documents, items):
    return {tuple(r) for r in decontaminate.contaminated(documents, items).select("doc_id", "item_id", "n_matched", "n_windows", "reparameterised").collect()}


def test_decontamination_equals_brute_force(spark, sf_dir):
    tables = [[tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    want = brute_templates(*tables)
    assert {(r["doc_id"], r["item_id"], r["n_matched"], r["n_windows"], r["reparameterised"]) for r in queries.op4_decontaminate(spark, sf_dir).collect()} == want
    assert {(d, i) for d, i, *_ in want} >= brute_contaminated(*tables) and want


def test_reparameterised_questions_equal_brute_force(spark):
    texts = [
        "Yesterday Анна продала 12 kg муки and Пётр купил 7 kg обратно for three days in Москва before the market closed again",
        "Mary has 12 apples and 5 pears in two baskets, and Mary gives John four of the apples at the old market. How many are left?",
        "a quick study of rivers shows that slow water carries less sand than fast water does", "old one \x01new word \x02seven of them all in a row here", "x", "", None, "Bob. Bob! Bob? 3 3 3",
    ]
    names = ["Анна", "Пётр", "Москва", "Mary", "John", "Ирина", "Олег", "Тверь", "Julia", "Tom", "12", "7", "5", "4", "15", "two", "three", "four", "nine"]
    rng = np.random.default_rng(11)
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, "word " * 30_000 + texts[2])]
    for n in range(160):
        swap = dict(zip(names, rng.choice(names, len(names), replace=bool(n % 2)).tolist(), strict=True))
        text = texts[n % 4]
        for a in names:
            text = re.sub(rf"(?<!\w){a}(?!\w)", f"<{a}>", text)
        text = re.sub(r"<(.+?)>", lambda m: swap[m[1]] if rng.random() < 0.8 else m[1], text)
        cut = text.split()
        lo, hi = sorted(rng.integers(0, len(cut) + 1, 2).tolist()) if n % 3 == 0 else (0, len(cut))
        rows.append((100 + n, " ".join(["Before it,", *cut[lo:hi], "and more."]) if n % 5 else text.replace("\x01", "")))
    items = list(enumerate(texts)) + [(1, texts[1]), (20, "the " * 3000 + "end")]
    want = brute_templates(rows, items)
    assert found_rows(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")) == want
    assert sum(c for *_, c in want) > 10 and len({d for d, *_ in want}) < len(rows) - 20


def test_numbers_may_become_equal_but_names_may_not(spark):
    item = "In a shop Anna had 12 apples and Peter had 5 pears, and later Anna and Peter shared all of the fruit"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("12", "4").replace("5", "4")), (2, item.replace("Peter", "Maria").replace("Anna", "Maria"))]
    assert {r[0] for r in found_rows(docs(spark, rows), items)} == {1}


def test_large_benchmark_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert found_rows(docs(spark, [(1, "so " + ITEM), (2, "no")]), items) == brute_templates([(1, "so " + ITEM), (2, "no")], [(1, ITEM)])


# 5


def test_token_counts_equal_the_chain(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocabulary = token_counts.Vocabulary(token_counts.load_pieces(path))
    got = token_counts.token_counts(docs(spark, EDGE), path).collect()
    assert len(got) == len(EDGE)
    text = dict(EDGE)
    for r in got:
        own = (text[r["doc_id"]] or "").split()
        assert r["n_words"] == len(own)
        assert r["n_tokens"] == sum(token_counts.chain_count(vocabulary, token_counts.MARK + w.encode()) for w in own)
    assert token_counts.token_counts(docs(spark, []), path).count() == 0
    rng = np.random.default_rng(3)
    for word in ("x" * 3000, "".join(rng.choice(list("etaoinshrdlé"), 20_000)), "".join(rng.choice(list("日本語の文字"), 3000))):
        raw = token_counts.MARK + word.encode()
        assert token_counts.long_count(vocabulary, raw, 700) == token_counts.chain_count(vocabulary, raw)
        assert token_counts.trie_counts(vocabulary, [raw]).tolist() == [token_counts.long_count(vocabulary, raw)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=9), unique=True, max_size=20), st.integers(0, 1000))
def test_trie_equals_all_segmentations(words_, seed):
    rng = np.random.default_rng(seed)
    pieces = {p.encode(): float(-rng.integers(1, 9)) for p in ("a", "b", "é", "ab", "ba", "aba", "bé", "▁a", "▁")}
    vocabulary = token_counts.Vocabulary(pieces)
    raw = [token_counts.MARK + w.encode() for w in words_]
    assert token_counts.trie_counts(vocabulary, raw).tolist() == [token_counts.chain_count(vocabulary, w) for w in raw]

    def best(w):
        if not w:
            return (0.0, 0)
        options = [(token_counts.PENALTY, 1)] + [(pieces[w[:k]], k) for k in range(1, len(w) + 1) if w[:k] in pieces]
        return max((s + best(w[k:])[0], best(w[k:])[1] - 1) for s, k in options)

    for w, n in zip(raw, token_counts.trie_counts(vocabulary, raw), strict=True):
        if len(w) < 9:
            assert n == -best(w)[1]


# 6


def test_preference_formatting(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "and?"), (0, 3, "assistant", "good"), (1, 0, "user", "ho"), (1, 1, "assistant", "bad"), (2, 0, "user", None), (3, 0, None, "x"), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r["conv_id"]: r for r in chat_format.preference(chat_format.reply_pairs(turns)).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    a = got[0]
    assert (a["n_prefix"], a["status"]) == (3, "ok")
    assert a["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nand?<|im_end|>\n"
    assert [a["chosen_completion"][m["begin"] : m["end"]] for m in a["chosen_mask"]] == ["good<|im_end|>\n"]
    assert [a["rejected_completion"][m["begin"] : m["end"]] for m in a["rejected_mask"]] == ["bad<|im_end|>\n"]
    assert got[2]["status"] == "identical" and got[2]["chosen_completion"] == "" and got[2]["chosen_mask"] == []
    assert got[4]["status"] == "one_sided" and got[4]["rejected_completion"] == "" and got[4]["chosen_completion"].count("user\na") == 2
    assert chat_format.preference(chat_format.reply_pairs(turns.limit(0))).count() == 0
    texts = turns.withColumn("conv_id", F.col("conv_id").cast("string")).unionByName(spark.createDataFrame([("new", 0, "assistant", "c", "extra"), ("00", 0, "assistant", "of 00", "extra")], turns.schema.simpleString()[7:-1].replace("conv_id:bigint", "conv_id:string").replace(":", " ")))
    named = {r["conv_id"]: r for r in chat_format.preference(chat_format.reply_pairs(texts)).collect()}
    assert set(named) == {"0", "1", "2", "3", "4", "new", "00"} and named["0"]["rejected_completion"] == a["rejected_completion"]
    assert named["new"]["status"] == "one_sided" and "good" in named["1"]["rejected_completion"]
    pairs = chat_format.reply_pairs(turns).selectExpr("*", "'mine' as prompt", "7 as n_prefix", "'kept' as note")
    clash = {r["conv_id"]: r for r in chat_format.preference(pairs).collect()}
    assert clash[0]["prompt"] == a["prompt"] and clash[0]["n_prefix"] == 3 and clash[0]["note"] == "kept"


# 7


def test_mixing_meets_weights_and_loses_nothing(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 3 else "small", i) for i in range(1500)] + [(5000, None, None, 1), (5001, "", "big", 1), (5001, "", "big", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_tokens int")
    out = mixing.mixed(d, target_entropy=0.99, max_repeats=3.0).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    tokens = Counter()
    for r in out:
        tokens[r["source"]] += len((r["text"] or "").split())
    exact = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in ("big", "small")}
    assert tokens["big"] == exact["big"]
    w = mixing.weights({**exact, "null": 0}, mixing.temperature({**exact, "null": 0}, 0.99, 3.0))
    assert abs(tokens["small"] / (tokens["small"] + tokens["big"]) - w["small"]) < 0.005
    assert all(0 <= r["mix_place"] <= 1 for r in out)
    assert mixing.mixed(d.limit(0)).count() == 0


def brute_mix(rows, target, limit, seed, spark, block_rows):
    """What a mixture holds, from the definition: blocks of hashed documents, permuted anew in each pass, until the budget ends."""
    import math

    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", mixing._id().alias("mix_id"))
    place = {(r["doc_id"], r["text"], r["source"]): (r["h"] >> 2) & ((1 << 62) - 1) for r in frame.selectExpr("*", f"xxhash64({seed}, mix_id) as h").collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r[2] or "null", []).append(r)
    size = {s: sum(len(words(r[1])) for r in x) for s, x in by.items()}
    w = mixing.weights(size, mixing.temperature(size, target, limit))
    often = {s: min(x, limit) for s, x in mixing.repeats(size, w).items()}
    out: Counter = Counter()
    for s, x in by.items():
        bits = math.ceil(math.log2(len(x) / block_rows)) if len(x) > block_rows else 0
        full = int(often[s] + 1e-9)
        for r in x:
            out[r[0]] += full
        numbers = spark.range(1 << bits).withColumn("n", F.col("id"))
        for k in range(mixing.ROUNDS):
            numbers = numbers.withColumn("n", mixing.folded(mixing.stirred(F.col("n"), F.lit((1 << bits) - 1).cast("long"), k, F.lit(seed), F.lit(full), F.lit(s)), F.lit((bits + 1) // 2)))
        order = {r["id"]: r["n"] for r in numbers.collect()}
        assert sorted(order.values()) == list(range(1 << bits))
        left = int((often[s] - full) * size[s]) if often[s] - full > 1e-9 else -1
        together: dict = {}  # documents of one place come together
        for r in x:
            h = place[r]
            together.setdefault((order[h >> (62 - bits)], h & ((1 << (62 - bits)) - 1)), []).append(r)
        for k in sorted(together):
            left -= sum(len(words(r[1])) for r in together[k])
            if left < 0:
                break
            for r in together[k]:
                out[r[0]] += 1
    return out


@pytest.mark.parametrize("block_rows", [4, 512])
def test_mixing_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    rows = [(i, "w " * (i * i % 11), ("big", "big", "mid", "big", "small", None)[i % 6]) for i in range(600)]
    rows += [(7, "w", "mid"), (7, "w", "mid"), (None, "a b", "mid"), (None, "c d e", "mid"), (9000, LONG, "big"), (9001, None, "small")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r["doc_id"] for r in mixing.mixed(d, 0.97, 2.5, 13).collect())
    assert got == brute_mix(rows, 0.97, 2.5, 13, spark, block_rows)
    assert max(got.values()) > 1


def test_mixing_keeps_blocks_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    d = spark.createDataFrame([(i, "w", "s" if i % 2 else "t") for i in range(256)], "doc_id long, text string, source string")
    place = "shiftrightunsigned(xxhash64(13, xxhash64(doc_id)), 2)"
    out = mixing.mixed(d, 0.93, 2.0, 13).selectExpr("*", f"shiftright({place}, 58) as block").where("mix_pass = 0 and source = 's'").orderBy("mix_place").collect()
    blocks = [r["block"] for r in out]
    runs = [b for i, b in enumerate(blocks) if not i or b != blocks[i - 1]]
    assert len(runs) == len(set(runs)) == 16 and runs != sorted(runs)


def test_temperature_and_limits():
    t = {"a": 900, "b": 90, "c": 10}
    a = mixing.temperature(t, 0.8, 1e9)
    assert abs(mixing.entropy(mixing.weights(t, a)) - 0.8) < 1e-6
    b = mixing.temperature(t, 1.0, 4.0)
    assert max(mixing.repeats(t, mixing.weights(t, b)).values()) <= 4.0 + 1e-6
    assert mixing.temperature({"a": 5}, 0.9, 2.0) == 1.0


# 8


def brute_vectors(rows, threshold):
    root, n = {i: i for i, _, _ in rows}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.asarray(v, float) / np.abs(v).max(), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("part", [1 << 14, 12, 3])
def test_embedding_dedup_is_exact(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    rows = [(i, (centre[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.5])).tolist(), int(i % 2)) for i in range(150)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(4)] + [(2000, [2 * x for x in rows[0][1]], rows[0][2]), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, [], 1), (2006, rows[0][1], None), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0)]
    rows += [(3000, [1e200, 1e200], 0), (3001, [1e200, 1.0001e200], 0), (3002, [1e-200, 1e-200], 1), (3003, [1e-200, 1.0001e-200], 1), (3004, [5e-324, 5e-324], 1), (3005, [1.7e308, -1.7e308], 1), (None, rows[0][1], 0)]
    d = spark.createDataFrame([(i, v, lab, 7) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(d).collect()}
    assert got == brute_vectors(rows, 0.98)
    assert got[3000][0] == got[3001][0] == 1 and got[3002][0] == got[3004][0] == 2
    assert embedding_dedup.embedding_dedup(d.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 4, 8]), st.sampled_from([1, 50, 2000]), st.sampled_from([0.02, 0.2, 1.0]))
def test_range_join_finds_each_pair_once(seed, dims, few, radius):
    rng = np.random.default_rng(seed)
    y, z = (rng.choice([rng.standard_normal((n, dims)), rng.integers(0, 2, (n, dims)).astype(float)]) * 0.3 for n in rng.integers(0, 150, 2).tolist())
    before, embedding_dedup.FEW = embedding_dedup.FEW, few
    try:
        alone = [(i, k) for p, q in embedding_dedup.in_range(y, None, radius**2) for i, k in zip(p.tolist(), q.tolist(), strict=True)]
        both = [(i, k) for p, q in embedding_dedup.in_range(y, z, radius**2) for i, k in zip(p.tolist(), q.tolist(), strict=True)]
    finally:
        embedding_dedup.FEW = before
    near = lambda x, w: bool(embedding_dedup.square((x - w)[None])[0] <= radius**2)
    assert sorted(tuple(sorted(p)) for p in alone) == [(i, k) for i in range(len(y)) for k in range(i + 1, len(y)) if near(y[i], y[k])]
    assert sorted(both) == [(i, k) for i in range(len(y)) for k in range(len(z)) if near(y[i], z[k])]


# 9


def test_quality_of_edge_rows(spark):
    d = docs(spark, EDGE)
    none = quality.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.scored(d, none, "own").collect()
    assert len(out) == len(EDGE) and {round(r["own"], 6) for r in out} == {0.5}
    one = quality.train(d, spark.createDataFrame([(1, 1), (5, 1), (9, None)], "doc_id long, quality int"))
    assert all(r["own"] > 0.9 for r in quality.scored(d, one, "own").collect())
    assert quality.scored(docs(spark, []), one, "own").count() == 0
    assert quality.scored(d, one, "own").columns == [*d.columns, "own"]
    clash = quality.scored(d.withColumnRenamed("n", "Score_"), one)
    assert clash.columns == [*d.columns[:5], "Score_", "bucket", "score__"] and {r["score"] for r in clash.collect()} == {0.5}
    tie = quality.train(d, spark.createDataFrame([(1, 0), (1, 1), (5, 1)], "doc_id long, quality int"))  # a mean of a half counts as 1
    assert all(r["own"] > 0.9 for r in quality.scored(d, tie, "own").collect())


def test_quality_equals_brute_force(spark):
    """Features and ratios written out; the hinge loss within a few per cent of the optimum; scores from the model's own weights."""
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(rng.choice(["good", "fine Words", "clear.", "and", "THE"] if i % 2 else ["bad", "xx", "1234", "BUY!", "the"], rng.integers(0, 12)))) for i in range(40)]
    label = {i: i % 2 for i, _ in texts}

    def features(text):
        data = (text or "").encode()
        out = {int.from_bytes(data[i : i + 3], "little") * 0x9E3779B1 % 2**32 >> (32 - quality.GRAM_BITS) for i in range(len(data) - 2)}
        shapes, before = [], None
        for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
            ups, lows = len(re.findall(rb"[A-Z]", w)), len(re.findall(rb"[a-z]", w))
            kind = 0 if re.match(rb"[A-Za-z\x80-\xff]", w[-1:]) else 1 if w[-1:].isdigit() else 2 if w[-1:] in b".,;:?'\")" else 3
            shapes.append((3 if ups > 1 and lows == 0 else ups > 0) + 4 * kind + 16 * (w == before) + 32 * (len(w) >= 12))
            before = w
        return out | {(1 << quality.GRAM_BITS) + a * quality.SHAPES + b for a, b in zip(shapes[:-1], shapes[1:], strict=True)}

    chunk = next(textvec.chunks(pa.array([t for _, t in texts], pa.string())))
    assert [set(np.flatnonzero(m).tolist()) for m in quality.marks(chunk)] == [features(t) for _, t in texts]
    model = quality.train(docs(spark, texts), spark.createDataFrame(list(label.items()), "doc_id long, quality int"))
    count = np.ones((2, quality.WIDTH))
    for i, t in texts:
        count[label[i], sorted(features(t))] += 1
    assert np.allclose(model["ratio"], np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum()))
    rows = [np.array(sorted(features(t)), int) for _, t in texts]
    x = np.zeros((len(rows), quality.WIDTH))
    for i, f in enumerate(rows):
        x[i, f] = model["ratio"][f] / (np.sqrt((model["ratio"][f] ** 2).sum()) or 1)
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.array([2 * label[i] - 1 for i, _ in texts])
    beta, plain = 0.25, model["weight"][np.setdiff1d(np.arange(quality.WIDTH), np.concatenate(rows))[0]]
    own = np.append((model["weight"] - plain) / beta, model["bias"] / beta)
    assert abs(plain - (1 - beta) * np.abs(own[:-1]).mean()) < 1e-9
    loss = lambda w: w @ w / 2 + np.maximum(1 - sign * (x @ w), 0).sum()
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(500):
        for i in range(len(x)):
            new = min(max(alpha[i] - (sign[i] * (x[i] @ w) - 1) / (x[i] @ x[i]), 0), 1)
            w += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new
    assert loss(own) <= 1.03 * loss(w)
    for r in quality.scored(docs(spark, texts), model, "own").collect():
        f = rows[r["doc_id"]]
        margin = sum(model["weight"][f] * model["ratio"][f]) / (np.sqrt((model["ratio"][f] ** 2).sum()) or 1) + model["bias"]
        assert abs(r["own"] - 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -30, 30)))) < 1e-9


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to hold some out
    rows = queries.op9_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


# 10


def test_language_model_base_scores(spark):
    rows = [(i, t) for i, t in EDGE if i != 8] + [(8, "Ünï çødé ßtring"), (20, "one" + "x" * 70_000)] + [(100 + i, f"the cat number {i} sat on the mat") for i in range(60)] + [(None, "the cat"), (0, "zero")]
    d = docs(spark, rows)
    held = queries.crc_mod("doc_id", 7) == 2
    model = language_model.train(d.where(~held).select("text"))
    got = {r["doc_id"]: r for r in language_model.scored(d.select("doc_id", "text"), model, held).collect()}
    out = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    count: Counter = Counter()
    for i, t in rows:
        if not out[i]:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        own = [*words(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r["base_score"] - sum(np.log10((count[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 * len(own)
        assert r["score"] < 0
    cats = [r for i, r in got.items() if i is not None and i >= 100]
    assert sum(r["score"] for r in cats) > 0.4 * sum(r["base_score"] for r in cats)
    assert language_model.scored(d.limit(0).select("doc_id", "text"), model, held).count() == 0


def hashes_of(texts):
    """Of each text its token hashes, the end last."""
    out = []
    for chunk in textvec.chunks(pa.array(texts, pa.string())):
        token, lengths = language_model.tokens(chunk)
        out += np.split(token, np.cumsum(lengths)[:-1])
    return [x.tolist() for x in out]


def brute_language_model(texts, learned, burn_in=2, kept=2):
    """log10 probabilities of texts by seating one dish at a time in dictionaries, in one pass, with unsampled discounts."""
    lm, end = language_model, int(textvec.END_TOKEN)
    one = lambda x, kind=np.uint64: np.array([x], kind)
    joint = lambda a, b: int(lm.joint(one(a), one(b))[0])
    draw = lambda c, p, o, d, theta, key, k: int(lm.tables(one(c, np.int64), one(p, float), one(o, np.int64), d, theta, one(key), k)[0])

    def triples(text):
        v = u = end
        for w in text:
            yield u, v, w
            u, v = (end, end) if w == end else (v, w)

    c3: Counter = Counter(x for t, on in zip(texts, learned, strict=True) if on for x in triples(t))
    uni: Counter = Counter()
    for (_, _, w), n in c3.items():
        uni[w] += n
    n1 = {w: len({v for _, v, x in c3 if x == w}) for w in uni}
    pairs_once = Counter((v, w) for _, v, w in c3)
    once = Counter()
    for (_, v, w), n in c3.items():
        once[v, w] += n
    guess = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a and b else 0.5
    assert set(once) == set(pairs_once)
    base, d0, c0 = 1 / (len(uni) + 1), guess(sum(x == 1 for x in n1.values()), sum(x == 2 for x in n1.values())), sum(n1.values())
    d = guess(sum(x == 1 for x in uni.values()), sum(x == 2 for x in uni.values()))
    t0, root, unknown = dict.fromkeys(uni, 1), Counter(), 0.0
    for k in range(burn_in + kept):
        total = sum(t0.values())
        if k >= burn_in:
            for w in uni:
                root[w] += (max(n1[w] - d0 * t0[w], 0) + (1 + d0 * total) * base) / (1 + c0) / kept
            unknown += (1 + d0 * total) * base / (1 + c0) / kept
        t0 = {w: draw(n1[w], base, total - t0[w], d0, 1.0, w, 1000 + k) for w in uni}
    group = {v: int(textvec.mix(one(v))[0]) for v in {v for _, v, _ in c3}}
    top = {w: i for i, w in enumerate(sorted(uni))}
    key2 = {x: joint(joint(group[x[1]], x[0] >> 32), top[x[2]]) for x in c3}
    key1 = {(v, w): joint(group[v], top[w]) for _, v, w in c3}
    t3, t2 = dict.fromkeys(c3, 1), dict.fromkeys(key1, 1)

    def totals():
        c2: Counter = Counter()
        for (_, v, w), t in t3.items():
            c2[v, w] += t
        by = lambda x, f: functools.reduce(lambda m, i: m.update({f(i): x[i]}) or m, x, Counter())
        return c2, by(c3, lambda i: i[:2]), by(t3, lambda i: i[:2]), by(c2, lambda i: i[0]), by(t2, lambda i: i[0])

    def p(u, v, w):
        c2, cp, tp, cg, tg = totals_now
        p0 = root[w] if w in uni else unknown
        p1 = (max(c2[v, w] - d * t2.get((v, w), 0), 0) + (1 + d * tg[v]) * p0) / (1 + cg[v])
        return (max(c3[u, v, w] - d * t3.get((u, v, w), 0), 0) + (1 + d * tp[u, v]) * p1) / (1 + cp[u, v])

    every = sorted({x for t in texts for x in triples(t)})
    out = dict.fromkeys(every, 0.0)
    for k in range(burn_in + kept):
        c2, cp, tp, cg, tg = totals()
        new = {}
        for (u, v, w), c in c3.items():
            t = t3[u, v, w]
            left = c2[v, w] - t
            stay = min(t2[v, w], left)
            above = (max(left - d * stay, 0) + (1 + d * (tg[v] - (t2[v, w] - stay))) * root[w]) / (1 + cg[v] - t)
            new[u, v, w] = draw(c, above, tp[u, v] - t, d, 1.0, key2[u, v, w], 2 * k)
        t3 = new
        c2 = totals()[0]
        t2 = {x: draw(c2[x], root[x[1]], tg[x[0]] - t2[x], d, 1.0, key1[x], 2 * k + 1) for x in t2}
        if k >= burn_in:
            totals_now = totals()
            for x in every:
                out[x] += p(*x) / kept
    return [sum(np.log10(out[x]) for x in triples(t)) for t in texts]


SMALL = ["the cat sat on the mat", "the cat sat on the hat", "a dog and the cat", "the dog sat", "", "the cat sat on the mat the cat sat on the mat", "a a a a a b a a b"]


def test_language_model_equals_brute_force(spark):
    texts = SMALL * 3 + ["the cow sat on a mat", "unheard words here", "dog", "mat the on"]
    learned = [i < 18 for i in range(len(texts))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = language_model.train(d.where("doc_id < 18").select("text"))
    got = {r["doc_id"]: r["score"] for r in language_model.scored(d, model, F.col("doc_id") >= 18, passes=1).collect()}
    want = brute_language_model(hashes_of(texts), learned)
    assert max(abs(got[i] - x) for i, x in enumerate(want)) < 1e-5


def test_language_model_takes_rare_and_split_contexts(spark, monkeypatch):
    """Few frequent words, groups of few tokens, repeated triples: the same counts, and scores that stay probabilities."""
    rows = [(i, f"the cat {i % 7} sat on the mat and the dog {i % 5} too " * 40) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    learned = d.where("doc_id % 4 <> 0").select("text")
    plain = {r["doc_id"]: r for r in language_model.scored(d, language_model.train(learned), F.col("doc_id") % 4 == 0).collect()}
    monkeypatch.setattr(language_model, "TOP", 6)
    few = language_model.train(learned)
    assert 0 < len(few["top"]) <= 6
    rare = {r["doc_id"]: r for r in language_model.scored(d, few, F.col("doc_id") % 4 == 0).collect()}
    for i, r in plain.items():
        assert abs(rare[i]["base_score"] - r["base_score"]) < 1e-6 and rare[i]["n_known"] == r["n_known"]
        assert abs(rare[i]["score"] - r["score"]) < 0.1 * abs(r["score"])


def test_language_model_seats_rare_words_by_their_own_probability(spark, monkeypatch):
    """With few frequent words all others are seated as by brute force too, each with its own probability in the root."""
    texts = SMALL * 30 + [f"{w} {v} {w} w{k % 9}" for k in range(90) for w, v in (("cat", "hat"), ("dog", "mat"))] + ["the cow sat on a mat", "unheard words here", "dog mat the on"]
    n = len(texts) - 3
    learned = [i < n for i in range(len(texts))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(language_model, "TOP", 4)
    model = language_model.train(d.where(f"doc_id < {n}").select("text"))
    assert 0 < len(model["top"]) <= 4
    got = {r["doc_id"]: r["score"] for r in language_model.scored(d, model, F.col("doc_id") >= n, passes=1).collect()}
    # A dish is told by its word's place among the frequent, or by its word's hash.
    trained = sorted({w for t, on in zip(hashes_of(texts), learned, strict=True) if on for w in t})
    top, joint = model["top"].tolist(), language_model.joint
    dish = {i: top.index(w) if w in top else w | 1 << 63 for i, w in enumerate(trained)}
    monkeypatch.setattr(language_model, "joint", lambda a, b: joint(a, np.array([dish.get(int(x), int(x)) for x in b], np.uint64)))
    want = brute_language_model(hashes_of(texts), learned)
    assert max(abs(got[i] - x) for i, x in enumerate(want)) < 1e-5


def test_language_model_is_the_same_on_any_partitions(spark):
    d = spark.createDataFrame([(i, SMALL[i % 7] + f" w{i % 11}") for i in range(120)], "doc_id long, text string")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            held = queries.crc_mod("doc_id", 7) == 2
            model = language_model.train(d.where(~held).select("text"))
            found.append({r["doc_id"]: r["score"] for r in language_model.scored(d.repartition(int(n), "doc_id"), model, held).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(abs(x - found[1][i]) for i, x in found[0].items()) < 1e-4


def test_seats_give_a_distribution():
    """In every context the probabilities of all words and of one unknown word sum to 1."""
    rng = np.random.default_rng(0)
    n = 400
    group, far, dish = rng.integers(0, 5, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint32), rng.integers(0, 9, n).astype(np.uint64)
    key = np.unique(np.stack([group, far.astype(np.uint64), dish]), axis=1)
    every = np.array([(g, f, w) for g in range(6) for f in range(5) for w in range(10)], np.uint64)  # more than was seen
    count = np.array([rng.integers(1, 40) if (key.T == x).all(1).any() else 0 for x in every])
    root = np.array([0.1] * 10)
    seats = language_model.Seats(every[:, 0], every[:, 1].astype(np.uint32), every[:, 2], count, root[every[:, 2].astype(int)])
    for k in range(4):
        seats.sweep([0.6, 0.4], [2.0, 0.5], k)
        a, b = seats.mixture([0.6, 0.4], [2.0, 0.5])
        p = (a + b * 0.1).reshape(30, 10)
        assert (seats.t >= np.minimum(seats.c, 1)).all() and (seats.t <= seats.c).all() and (seats.t_low <= seats.low_customers()).all()
        assert np.abs(p.sum(1) - 1).max() < 1e-9


def test_language_model_without_training(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    model = language_model.train(d.select("text").limit(0))
    got = language_model.scored(d.select("doc_id", "text"), model, F.lit(True)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}


@settings(max_examples=20, deadline=None)
@given(st.floats(0.1, 0.9), st.integers(2, 400), st.integers(0, 300), st.floats(1e-4, 1))
def test_tables_follow_their_distribution(d, n, others, p):
    d, m = round(d, 2), 3000
    t = language_model.tables(np.full(m, n), np.full(m, p), np.full(m, others), d, 1.0, np.arange(m, dtype=np.uint64), 3)
    stirling = language_model.log_stirling(d, n)[n, 1:]
    weight = stirling + np.cumsum(np.log(1 + d * (others + np.arange(n))) + np.log(p))
    weight = np.exp(weight - weight.max())
    mean = (weight * np.arange(1, n + 1)).sum() / weight.sum()
    assert 1 <= t.min() and t.max() <= n
    assert abs(t.mean() - mean) < 0.04 * mean + 0.05


@settings(max_examples=20, deadline=None)
@given(st.floats(0.05, 0.95), st.integers(257, 600), st.integers(1, 600))
def test_large_stirling_numbers(d, c, t):
    d, t = round(d, 2), min(t, c)
    found = language_model.large_stirling(np.array([c]), np.array([t]), d)[0]
    assert abs(found - language_model.log_stirling(d, c)[c, t]) < 0.01
    rise = sum(np.log(0.3 + d * i) for i in range(1, c))
    assert abs(language_model.log_rise(0.3, d, np.array([c]))[0] - rise) < 1e-8 * (1 + abs(rise))


def test_large_restaurants_tell_discounts(monkeypatch):
    """What restaurants and dishes beyond the bounds of the counts say is what it says within them."""
    rng = np.random.default_rng(2)
    n = 60
    seats = language_model.Seats(np.zeros(n, np.uint64), np.arange(n, dtype=np.uint32) // 20, np.arange(n, dtype=np.uint64) % 20, rng.integers(1, 120, n), np.full(n, 0.05))
    for k in range(3):
        seats.sweep([0.6, 0.4], [1.0, 1.0], k)

    def drawn():
        place, count, more = seats.histograms()
        told = np.zeros(2 * (2 * (language_model.LARGE + 1) + (language_model.EXACT + 1) ** 2), np.int64)
        told[place] = count
        return [language_model.sampled(told, np.random.default_rng(i), more) for i in range(50)]

    whole = drawn()
    assert len({str(x) for x in whole}) > 5
    monkeypatch.setattr(language_model, "LARGE", 100)
    assert seats.total.min() > 100 and drawn() == whole


def test_discounts_are_told_by_the_seating():
    """Seats that follow a discount lead back to it."""
    rng = np.random.default_rng(1)
    d, theta = 0.6, 1.0
    sizes = 2 * (language_model.LARGE + 1) + (language_model.EXACT + 1) ** 2
    level = np.zeros(sizes, np.int64)
    for _ in range(600):
        tabs: list = []
        for i in range(60):
            weight = np.array([*(x - d for x, _ in tabs), theta + d * len(tabs)])
            k = int(rng.choice(len(weight), p=weight / (theta + i)))
            if k == len(tabs):
                tabs.append([1, int(rng.integers(0, 40))])
            else:
                tabs[k][0] += 1
        level[60] += 1
        level[language_model.LARGE + 1 + len(tabs)] += 1
        for w in {w for _, w in tabs}:
            own = [x for x, y in tabs if y == w]
            if sum(own) > 1:
                level[2 * (language_model.LARGE + 1) + sum(own) * (language_model.EXACT + 1) + len(own)] += 1
    found, _ = language_model.sampled(np.concatenate([level, level]), rng)
    assert all(abs(x - d) <= 0.1 for x in found)
