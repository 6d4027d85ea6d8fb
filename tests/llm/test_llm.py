import hashlib
import html as entities
import json
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import regex
import sentencepiece
import xxhash

from meandra.llm import chat, common, components, decontamination, html, nearcopies, pieces, queries, sharding, simhash, substrings, topk, toxicity, urls
from meandra.operators import graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=0):
    rng = random.Random(seed)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.choice([0, 1, 3, 40, 60, 120, 300]))) for i in range(60)]
    rows += [(100 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 20)) for i in range(12)]
    base = prose(rng, 200)
    rows += [(200 + i, base) for i in range(8)]
    rows += [(300 + i, base.replace(WORDS[7], f"x{i}", 1) + f" y{i}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "Ä" * 5000), (404, "same " * 3000), (405, "same " * 2000), (5, rows[5][1]), (None, base)]
    rng.shuffle(rows)
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def empty(spark):
    return docs_of(spark, [])


# ---- SimHash ----------------------------------------------------------------------------------
def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("page", [256, 2])
def test_simhash_equals_brute_force(spark, page):
    rows = corpus()
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = plain_components(prints)
    out = simhash.near_duplicates(docs_of(spark, rows), page).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
        else:
            assert r["component_id"] is not None


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 20, dtype=np.uint64)
    v = np.unique([int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(30)]).astype(np.uint64)
    a, b = simhash.trie_pairs(v, np.array([0, len(v)]))
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2)
    assert set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) == {(x, y) for x, y in zip(i.tolist(), j.tolist()) if x < y}


def test_dedup_keeps_one_row_a_component(spark):
    docs = docs_of(spark, corpus()).withColumn("fp", common.F.lit("clash"))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {r["component_id"] for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert simhash.deduplicate(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in components.components(chain).collect()} == {0}
    assert components.components(chain.filter("a < 0")).count() == 0


def test_few_edges_are_united_without_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)] + [(500, 500), (501, 501), (501, 502), (7, None), (None, None)]
    edges = spark.createDataFrame(edges + edges[:20], "a long, b long")
    rows = lambda found: sorted(map(tuple, found.collect()))
    want = rows(components.components(edges))
    n = edges.filter("a is not null and b is not null").count()
    assert rows(components.components(edges, few=n - 1)) == want and len(want) > 200
    docs = docs_of(spark, [(k, " ".join(f"w{k // 20}x{i}" for i in range(30)) + f" end{k}") for k in range(60)])
    kept = lambda: sorted(r["doc_id"] for r in nearcopies.deduplicate(docs).collect() if r["doc_id"] is not None)
    monkeypatch.setattr(graph, "components", None)
    assert rows(components.components(edges, few=n)) == want
    assert components.components(edges.filter("a > 1000"), few=n).dtypes == [("node", "bigint"), ("root", "bigint")]
    assert components.components(edges.filter("a > 1000"), few=n).count() == 0
    assert kept() == [0, 20, 40]


@pytest.mark.parametrize("page", [16, 2])
def test_near_copies_equal_brute_force(spark, page, monkeypatch):
    import corpus_pipeline as P

    rng = random.Random(6)
    rows = corpus(6)
    for g in range(6):  # versions of a text with one to four of 100 words changed, and a hot group
        base = [rng.choice(WORDS) for _ in range(100)]
        for v in range(40 if g == 0 else 6):
            words = list(base)
            for k in range(v % 5):
                words[rng.randrange(100)] = f"v{v}x{k}"
            rows.append((1000 + 100 * g + v, " ".join(words)))
    if page == 2:  # small blocks and few leaders: askers and others meet in many parts
        for name, size in (("LEADERS", 1), ("CHUNK", 7), ("BLOCK", 5)):
            monkeypatch.setattr(nearcopies, name, size)
    rows = [r for r in rows if r[0] != 5]
    docs = docs_of(spark, rows).withColumns({c: common.F.lit("clash") for c in ("h", "node", "bands", "_row")})
    cut_up = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids, sets = zip(*((i, cut_up((t or "").lower().split())) for i, t in rows if i is not None))
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    want = {}
    for i, d in enumerate(ids):
        want[find(i)] = min(d, want.get(find(i), d))
    kept = nearcopies.deduplicate(docs, page=page)
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and got.count(None) == 1
    got = sorted(x for x in got if x is not None)
    assert got == sorted(want.values())
    staged = P.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in staged.collect() if r["doc_id"] is not None) == sorted(want.values())
    assert nearcopies.deduplicate(empty(spark)).count() == 0


# ---- sharding ---------------------------------------------------------------------------------
def test_shards_are_even_and_gapless(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(5, 30))) for i in range(1500)] + [(2000 + i, "hot text " * 9) for i in range(700)] + [(None, None), (7, "again"), (7, "again")]
    out = sharding.shard(docs_of(spark, rows)).toPandas()
    assert len(out) == len(rows) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    size = out.groupby("shard")["size"].sum()
    assert list(size.index) == list(range(40)) and size.max() < 1.1 * size.mean() and size.min() > 0.9 * size.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    assert set(out[out.doc_id == 7].text_crc32) <= {zlib.crc32(t.encode()) for i, t in rows if i == 7}
    assert out[out["size"] == 16].text_crc32.tolist() == [0]
    assert sharding.shard(empty(spark)).count() == 0


# ---- decontamination --------------------------------------------------------------------------
ITEMS = [(1, "The tall tree near old Anna holds 12 km of rope and 7 birds in spring"), (2, "short item here"), (3, None), (4, "a quick brown fox jumps over one lazy dog every single morning"), (None, "nothing to see here at all my friend")]


def test_leaks_and_slots(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, "foo bar. the tall tree near old Boris holds 99 km of rope and 3 birds in spring, they said"),
        (2, "we saw a quick brown fox jumps over one lazy dog every single morning today"),
        (3, "a quick brown fox sat down and one lazy dog slept"),
        (4, "Short item here!"), (8, "this short item here ends"),
        (5, None), (6, ""), (7, "12 12 12 12 12 12 12 12 12 12"), (None, ITEMS[3][1]), (2, "other text"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 4), (4, 2)}
    left = [r["doc_id"] for r in decontamination.decontaminate(docs_of(spark, rows), bench).collect()]
    assert sorted(x for x in left if x is not None) == [3, 5, 6, 7, 8] and None in left
    assert decontamination.leaks(empty(spark), bench).count() == 0
    assert decontamination.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_one_value_stands_for_one_value(spark):
    bench = spark.createDataFrame([(1, "add 5 apples to 5 pears and then count 5 plums again")], "item_id long, text string")
    rows = [(1, "add 8 apples to 8 pears and then count 8 plums again"), (2, "add 8 apples to 9 pears and then count 4 plums again")]
    assert {r["doc_id"] for r in decontamination.leaks(docs_of(spark, rows), bench).collect()} == {1}


def test_copies_in_another_case_are_leaks(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, "SEE: " + ITEMS[3][1].upper() + " OR NOT"), (2, "so " + ITEMS[0][1].lower() + " it is"), (3, "THE TALL TREE NEAR OLD WALLS STANDS ALONE")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 4), (2, 1)}


def plain_leaks(docs, items, width=5, share=0.8):
    """(doc, item) pairs by the operator's definition, every document against every item."""
    space = r"[\x20\x09-\x0D]+"

    def valued(t):
        t = regex.sub(decontamination._NAME, r"<name=\g<0>>", t.translate({60: None, 62: None, 61: None}))
        if not regex.search(r"\d", t, regex.ASCII):
            return t
        t = regex.sub(decontamination._NUMBER, r"<num=\g<0>>", t, flags=regex.ASCII)
        return regex.sub(rf"(<num=[^>]*>)\x20?(?i:({decontamination.UNITS}))(?![\p{{L}}\d])", r"\1 <unit=\2>", t, flags=regex.ASCII)

    def cleaned(v):
        v = regex.sub("=[^>]*>", ">", v).lower()
        return regex.sub(r"[^\p{L}\p{M}\p{N}<>\x20\x09-\x0D]+", "", v)

    def words(v):
        return [w for w in regex.split(space, cleaned(v)) if w]

    def slots(v):
        rows = [(cleaned(w), (regex.findall("=([^>]*)>", w) or [""])[0].lower()) for w in regex.split(space, v)]
        rows = [r for r in rows if r[0]]
        return {i: r for i, r in enumerate(rows) if r[0].startswith("<")}

    def windows(w, size):
        return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]

    made = {}
    for d, t in docs:
        bare = t.translate({60: None, 62: None, 61: None})
        made.setdefault(d, []).append((words(valued(t)), words(bare), slots(valued(t))))
    out = set()
    for k, t in items:
        v = valued(t)
        for literal, w in ((False, words(v)), (True, words(t.translate({60: None, 62: None, 61: None})))):
            size = min(width, len(w))
            if not size:
                continue
            own = windows(w, size)
            need = math.ceil(len(set(own)) * share - 1e-9)
            whole = size < width  # a short item is a text of its own
            asked = slots(v)
            for d, texts in made.items():
                there = {x for tw, bw, _ in texts for x in windows(bw if literal else tw, size) if not whole or len(bw if literal else tw) == size}
                if len(set(own) & there) < need:
                    continue
                if literal or not any(x.startswith("<") for x in w):
                    out.add((d, k))
                    continue
                for tw, _, given in texts:
                    for shift in range(-len(own), len(tw)):
                        line = sum(0 <= i + shift and tuple(tw[i + shift : i + shift + size]) == x for i, x in enumerate(own))
                        if line < math.ceil(len(own) * share - 1e-9):
                            continue
                        values = {}
                        for i, (kind, value) in asked.items():
                            if i + shift in given and given[i + shift][0] == kind:
                                values.setdefault((kind, value), set()).add(given[i + shift][1])
                        if all(len(x) == 1 for x in values.values()):
                            out.add((d, k))
    return out


def test_leaks_equal_brute_force(spark, sf):
    docs, bench = (common.table(spark, sf, t) for t in ("documents", "benchmark"))
    want = plain_leaks([(r["doc_id"], r["text"] or "") for r in docs.collect()], [(r["item_id"], r["text"] or "") for r in bench.collect()])
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert got == want and len(want) >= 3


def test_windows_of_texts_call_no_lambda_and_equal_those_of_items(spark):
    rows = [(i, f"w{i} " * i, " ".join(f"b{k}" for k in range(j))) for i, j in [(0, 0), (0, 3), (2, 0), (1, 2), (3, 4), (4, 5), (5, 5), (6, 9), (12, 7)]]
    words = spark.createDataFrame(rows, "doc_id long, w string, b string")
    words = words.select("doc_id", *(common.F.array_remove(common.F.split(c, " "), "").alias(n) for c, n in (("w", "words"), ("b", "bare"))))
    made = decontamination._text_windows(words, [5, 2, 3])
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()  # a call for each window took a third of the time
    want = []
    for c in ("words", "bare"):
        for w in (2, 3, 5):
            fit = words.filter(common.F.size(c) >= 5 if w == 5 else common.F.size(c) == w)
            want += fit.select("doc_id", common.F.explode(decontamination._windows(common.F.col(c), w, c == "bare")).alias("x")).select("doc_id", "x.h", "x.at").collect()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want)) and len(want) == 25


def test_leaks_in_german_and_in_long_texts(spark):
    items = [(1, "Der alte Mann geht mit seinem Hund durch den kleinen Park und kauft 3 Brote"), (2, "Im Garten steht ein Baum mit roten Blumen neben dem Haus der Familie")]
    other = "Die junge Frau fährt mit ihrem Wagen durch die große Stadt und sieht viele Häuser. Im Sommer steht ein Stuhl mit weißen Kissen neben dem Tisch."
    rows = [(1, other), (2, "Wir lasen: " + items[0][1] + ". Danach war Ruhe."), (3, items[0][1].replace("3", "8")), (4, "wort " * 60_000 + items[1][1] + " wort" * 60_000), (5, "Der Hund geht mit dem Mann.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(spark, rows).withColumn("h", common.F.lit(1)), bench.withColumn("words", common.F.lit(2))).collect()}
    assert got == {(2, 1), (3, 1), (4, 2)}


# ---- pieces -----------------------------------------------------------------------------------
def test_pieces_equal_the_library(spark, sf):
    data = pieces.read_model(queries.PIECE_MODEL)
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceModel.load(data)
    texts = ["", " ", "  a  b ", "Hello  world\n\tété ﬁ x ", "日本語 😀😀 a😀b", "x" * 300, "▁a ▁", "\x00\x01", "<s> </s> <0x41>", "aaaa bbb " * 50]
    texts += [r["text"] or "" for r in common.table(spark, sf, "documents").limit(60).collect()]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t) and own.decode(ids) == lib.decode(ids)
        assert own.decode(ids) == t.replace(pieces.META, " ")  # a meta symbol in a text reads as a space, as in the library
        assert own._path(own.words(own.normalise(t))[0] if t else "") is not None


def field(number, value):
    """A field of a protocol-buffer message."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(kind, words, rules=b"", user=(), squeeze=1, fallback=True):
    """A model that was not trained: its pieces are given, with scores by their rank."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(u, 0.0, 4) for u in user]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    rows += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    pieces_ = b"".join(field(1, field(1, p) + field(2, s) + field(3, t)) for p, s, t in rows)
    trainer = field(3, kind) + (field(35, 1) if fallback else b"")
    return pieces_ + field(2, trainer) + field(3, (field(2, rules) if rules else b"") + field(3, 1) + field(4, squeeze) + field(5, 1))


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc"])
def test_other_models_equal_the_library(kind, fallback, rule):
    names = ["▁", "a", "b", "c", "d", "e", "ab", "▁a", "bc", "▁ab", "cd", "abc", "▁abc", "de", "cde", "é", "▁é", "f", "i", "fi", "ガ", "1"]
    rules = b""
    if rule:
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        rules = dict(pieces._fields(dict(pieces._fields(spec))[3]))[2]
    for squeeze in (0, 1):
        data = model_file(kind, names, rules, user=("[X]", "<tag>"), squeeze=squeeze, fallback=fallback)
        lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceModel.load(data)
        texts = ["", " ", "abc abcde", "  a  b ", "cdeabc cd e", "xyz abc xx", "a[X]bc <tag>", "é ab", "ﬁ ab ｶﾞ ①", "ab\tcd\u00a0e", "aabbccddee" * 30, "[X][X]", "ab\n\nab", "e\u0301 a"]
        for t in texts:
            assert own.encode(t) == lib.encode(t), (t, squeeze)
            assert own.decode(own.encode(t)) == lib.decode(lib.encode(t)), (t, squeeze)


def test_bad_ids_have_an_answer(spark):
    model = pieces.PieceModel.load(pieces.read_model(queries.PIECE_MODEL))
    ids = model.encode("so it goes")
    assert model.decode([*ids, 10**6, None, -5]) == "so it goes \u2047  \u2047 "
    assert model.decode([None]) == ""


def test_words_that_go_on_are_solved_once(monkeypatch):
    # when the memory for words was full, all were dropped and solved anew
    monkeypatch.setattr(pieces, "CACHE", 64)
    data = pieces.read_model(queries.PIECE_MODEL)
    model, library = pieces.PieceModel.load(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    asked, solve = [], model._solve
    monkeypatch.setattr(model, "_solve", lambda words: asked.extend(words) or solve(words))
    often = " ".join(f"often{i}" for i in range(20))
    for k in range(30):
        text = often + " " + " ".join(f"rare{k}x{i}" for i in range(20))
        assert model.encode(text) == library.encode(text)
        assert len(model._words) + len(model._older) <= 4 * 64
    assert len(asked) == len(set(asked)) == 620


def test_slots_hold_what_a_dict_holds():
    rng = np.random.default_rng(3)
    slots, held = pieces._Slots(np.int32), {}
    for n in (0, 1, 400, 3000, 50):
        keys = np.setdiff1d(rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64(~0xFFF & (1 << 64) - 1), np.fromiter(held, np.uint64, len(held)))
        values = rng.integers(-1, 1000, len(keys)).astype(np.int32)
        slots.add(keys, values)
        held |= dict(zip(keys.tolist(), values.tolist()))
        asked = np.concatenate((np.fromiter(held, np.uint64, len(held)), keys + np.uint64(1), np.zeros(1, np.uint64)))
        assert slots.of(asked).tolist() == [held.get(k, pieces._FREE) for k in asked.tolist()]
    crowded = pieces._Slots(np.int8)  # keys of one slot, the last of all: the next ones are at the start
    last = np.arange(1, 1 << 16, dtype=np.uint64)
    last = last[crowded._slot(last) == 1023][:40]
    crowded.add(last, np.ones(len(last), np.int8))
    assert len(last) == 40 and (crowded.of(last) == 1).all() and crowded.of(np.arange(1, 9, dtype=np.uint64)).tolist().count(1) == np.isin(np.arange(1, 9), last).sum()


def test_piece_frames_round_trip(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "c"), (1, "a b")]
    data = pieces.read_model(queries.PIECE_MODEL)
    back = pieces.decode(pieces.encode(docs_of(spark, rows), data), data).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(rows, key=key)
    tripped = pieces.round_trips(docs_of(spark, rows).withColumn("ids", common.F.lit(1)), data).collect()
    assert len(tripped) == 5 and all(r["round_trip"] is (None if r["doc_id"] == 2 else True) for r in tripped)
    out = {r["doc_id"]: r for r in pieces.digests(docs_of(spark, rows), data).collect()}
    assert out[2]["n_ids"] is None and out[3]["n_ids"] == 0 and out[1]["round_trip"]


# ---- URLs -------------------------------------------------------------------------------------
def test_rules_and_trees(spark):
    rng = random.Random(5)
    rows = [(i, f"http://{rng.choice('abc')}{i}.example.{t}/{p}/{i}?q={i}") for i, (t, p) in enumerate((rng.choice(["net", "com", "org"]), rng.choice(["en", "de", "fr"])) for _ in range(300))]
    rows += [(1000, None), (1001, "no scheme"), (1002, "http://NET/x"), (1003, "http://a.example.net"), (1004, "x://example.net/en/a://b"), (1005, "http://notexample.com/de/"), (None, "http://q.org/fr/1#z")]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, html string")).collect()}
    assert out[1000]["host"] == out[1000]["path"] == out[1001]["host"] == "" and out[1000]["rule"] is None
    assert (out[1002]["host"], out[1002]["rule"], out[1002]["verdict"]) == ("net", "net/", "block")
    assert out[1003]["rule"] is None and out[1003]["path"] == ""
    assert (out[1004]["rule"], out[1004]["verdict"]) == ("example.net/en/", "allow")
    assert out[1005]["rule"] is None and out[None]["rule"] == "org/fr/"
    plain = [r for i, r in out.items() if i is not None and i < 300]
    ruled = [r for r in plain if r["rule"]]
    assert np.mean([(r["score"] > 0) == (r["verdict"] == "block") for r in ruled]) > 0.95
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ---- chat -------------------------------------------------------------------------------------
def test_chats_collapse_to_maximal_ones(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", None), (None, "d"), ("user", "e")]
    rows = [(c, i, *turns[i]) for c, n in ((1, 2), (2, 5), (3, 5), (4, 3)) for i in range(n)] + [(5, 0, "user", "other"), (5, 0, "user", "other"), (None, 0, "user", "a"), (6, None, "user", "z")]
    rows += [(9, i, "user", f"t{i}") for i in range(700)] + [(10, i, "user", f"t{i}") for i in range(650)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.withColumns({c: chat.F.lit("clash") for c in ("part", "nr", "base", "a", "h1")})).toPandas()
    assert set(out.conv_id) == {2, 5, 6, 9} and list(out.columns) == ["conv_id", "place", "n_turns", "rendered"] and len(out[out.conv_id == 2]) == 5 and len(out[out.conv_id == 5]) == 1
    nine = out[out.conv_id == 9].sort_values("place")
    assert nine.place.tolist() == list(range(1, 701)) and nine.rendered.iloc[3] == "<|user|>\nt3<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- HTML -------------------------------------------------------------------------------------
def test_main_text():
    page = '<html><head><title>no</title></head><body><header>Site</header><nav><a>x</a></nav><div class="cookie-notice">ok?</div><article><header><h1>T &amp; t</h1></header><p>one\n  two<br>three<p><b>four</b> &eacute;<form>mail</form><div class="comments"><p>first!</p></div></article><aside>s</aside><footer>f</footer>'
    assert html.main_text(page) == "T & t\n\none two three\n\nfour é"
    assert html.main_text("") == "" and html.main_text("plain <b>text</b> only") == "plain text only"
    assert html.main_text('<script>var t="</p><article>";</script><main><p>a</p></main><p>b</p>') == "a"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="no-sidebar"><article><p>story</p></article></body>',
        '<div class="content with-sidebar"><article><p>story</p></article><div class="sidebar">s</div></div>',
        '<article class="post social-share"><p>story</p></article>',
        '<div id="form-theory"><p>story</p></div>',
        '<div class="banner"><article><p>story</p><div class="comment-list">c</div></article></div>',
        '<html><head><title>t</title><meta charset="utf-8"><body><p>story</p><div class="site-footer">f</div>',
        "<html><head><title>t<body><p>story</p>",
        "<p>story<svg><path/><div class='ad'>x</div>",
    ],
)
def test_marks_and_open_heads_keep_the_main_text(page):
    assert html.main_text(page) == "story"


def test_inline_classes_and_slashes_keep_the_main_text():
    assert html.main_text('<article><p>Our social media <span class="related-term">policy</span> <b class="ad">matters</b></p></article>') == "Our social media policy matters"
    assert html.main_text('<article><p>a</p><script src="x"/>var a=1;</script><div/><p>b</p></article>') == "a\n\nb"
    assert html.main_text("<article><p title='a > b' data-x=\"1\" \">x</p><p>1 < 2 <y") == "x\n\n1 < 2 <y"


@pytest.mark.parametrize("page", ["<a " + '"x" ' * 200_000, "<div>" * 50_000 + "x", "<svg>" * 100_000, "<a <a " * 150_000, "<b>" * 20_000 + "</x>" * 50_000, '<a x="1" ' * 100_000, '<a x="' * 100_000, "<b>" * 20_000 + "<div></div>" * 20_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 5


def test_template_inside_articles(spark):
    body = '<body><article><div class="box">Join our list</div><h2>Summary</h2><p>the same line</p><p>story {0}</p><div class="x">{1}</div></article></body>'
    rows = [(i, f"http://h.x/{i}", body.format(i, "often" if i % 2 else "rarely")) for i in range(8)]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Summary\n\nthe same line\n\nstory 3\n\noften"


def test_extraction_equals_a_plain_reading_of_the_pages(spark, sf):
    pages = common.table(spark, sf, "pages").withColumn("host", common.F.lit("clash")).withColumn("template", common.F.lit("clash"))
    want = []
    for r in pages.collect():  # these pages hold their article as headings, paragraphs and bold text
        article = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:h1|p)>", article[1]) if article else []
        texts = [" ".join(entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        want.append((r["page_id"], "\n\n".join(t for t in texts if t)))
    got = [(r["page_id"], r["text"]) for r in html.extract(pages).collect()]
    assert sorted(got) == sorted(want)


def test_template_text_is_left_out(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><div>Welcome to our place</div><div><p>story {i} tells of {i * 7}</p></div></body>") for i in range(6)]
    rows += [(50, "http://h.x/art", "<article><p>Welcome to our place</p></article>"), (51, None, None), (None, "http://h.x/n", ""), (52, "http://lone/", "<p>Welcome to our place</p>")]
    out = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows) and out[3]["text"] == "story 3 tells of 21"
    assert out[50]["text"] == out[52]["text"] == "Welcome to our place" and out[51]["text"] == "" and out[None]["n_chars"] == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- toxicity ---------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) + (" what a vile rotten goblin, truly loathsome " if i % 5 == 0 else " ") + prose(rng, 60)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (None, None), (9000, ""), (9001, "word " * 50_000)])
    out = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(out) == len(rows) + 3 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    known = out[out.doc_id.notna() & (out.doc_id < 600)]
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in known.doc_id]).all()
    test = known[known.held_out]
    assert (test.predicted == (test.doc_id % 5 == 0)).mean() > 0.97
    assert toxicity.score(empty(spark), toxicity.fit_texts([], [])).count() == 0
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.filter("doc_id % 5 <> 0 and doc_id < 600").count() >= 470


def test_near_copies_do_not_speak_for_their_words(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80) + (f" what a {rng.choice(WORDS)} vile {rng.choice(WORDS)} goblin " if i % 8 == 0 else " ") + prose(rng, 80)) for i in range(1200)]
    family = [f"fam{k}" for k in range(120)]  # one toxic text in many versions, with words of its own
    rows += [(8 * (1000 + v), " ".join(family[:60] + [f"x{v}", "vile"] + family[60:])) for v in range(150)]
    rows += [(20_000 + i, prose(rng, 40) + " " + " ".join(rng.sample(family, 2)) + " " + prose(rng, 40)) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0 and i < 20_000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, rows).withColumn("k", common.F.lit("clash")), labels.unionByName(labels.limit(50)))
    learnt = set(model.toxic.split()) - set(model.ordinary.split())
    assert {b"vile", b"goblin"} <= learnt and not any(w.startswith(b"fam") for w in learnt)
    known = {i: t for i, t in rows}
    train = [i for i in known if zlib.crc32(str(i).encode()) % 4 != 2]
    twin = toxicity.fit_texts([known[i].encode() for i in train if i % 8 == 0 and i < 20_000], [known[i].encode() for i in train if i % 8 or i >= 20_000])
    assert (twin.toxic, twin.ordinary) == (model.toxic, model.ordinary) and np.allclose(twin.weights, model.weights, rtol=1e-4)


def test_toxic_stems_of_a_small_language_are_learnt():
    rng = random.Random(4)
    around = lambda s: f"{prose(rng, rng.randint(5, 90))} {s} {prose(rng, rng.randint(5, 90))}".encode()
    stems = lambda: " ".join(f"groußk{rng.choice('abcdefghij')}{rng.choice('klmnopqrs')} {prose(rng, 9)}" for _ in range(4))
    toxic = [around("vile goblin" if i % 10 else "vilest goblin") for i in range(200)] + [around(stems()) for _ in range(14)]
    model = toxicity.fit_texts(toxic, [around("") for _ in range(1500)])
    caught = lambda s: sum(model.score(toxicity.plain_words(around(s))) >= toxicity.THRESHOLD for _ in range(50))
    assert caught(stems()) >= 47 and caught("") <= 1


# ---- top-k ------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [16_384, 150, 40])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    if block == 40:
        monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v[100:260] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1100, [float("nan")] * 16), (1200, [1.0, None] * 8), (1300, []), (1400, [2.0, 1.0]), (None, v[0].tolist())]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).toPandas()
    m = np.floor(v.astype(float) * 1024).astype(np.int64)
    for q in range(0, 500, 100):
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(500), -s)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == order and mine.score.tolist() == s[order].tolist()
    assert set(got.query_id) == set(range(0, 500, 100))
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_repeated_ids_clusters_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8)) * 20
    v = np.concatenate([c + rng.normal(size=(40, 8)) for c in centres])
    rows = [(i // 2 * 2, x.tolist(), "clash", 1) for i, x in enumerate(v)]  # pairs of rows share an id
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, nr string, pivot int"), every=20, block=40).toPandas()
    m = np.floor(v * 1024).astype(np.int64)
    ids = np.array([r[0] for r in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = m @ m[q]
        want += [(ids[q], k + 1, ids[i], s[i]) for k, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:10])]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == sorted(tuple(map(int, w)) for w in want)
    with pytest.raises(Exception):
        topk.top_k(spark.createDataFrame([(1, [1e9, 1e9])], "vec_id long, embedding array<double>")).collect()


# ---- substrings -------------------------------------------------------------------------------
def plain_repeats(rows):
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 49):
            if i is not None:
                k = tuple(w[s : s + 50])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if i is not None and least[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("page", [32_768, 3])
def test_substrings_equal_brute_force(spark, page):
    rows = corpus(7)
    out = substrings.repeated_passages(docs_of(spark, rows), page).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in out) == plain_repeats(rows)


def test_removed_passages_leave_columns(spark):
    docs = docs_of(spark, corpus(8)).withColumns({c: common.F.lit("clash") for c in ("_id", "_body", "_kept", "_now", "anchor", "a.b")})
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert substrings.remove_repeats(empty(spark)).count() == 0


# ---- queries and pipeline ---------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() >= 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = common.table(spark, sf, "documents")
    columns, n = docs.columns, [docs.count()]
    for _, stage in P.STAGES:
        docs = common.cut(stage(spark, docs, sf))
        n.append(docs.count())
    assert [name for name, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    assert n == sorted(n, reverse=True) and n[-1] == n[-2] > 0
    assert {"doc_id", "ids"} <= set(docs.columns) and docs.filter("not round_trip").count() == 0
    whole = P.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], json.dumps(r["ids"])) for r in df.select("doc_id", "ids").collect())
    assert key(whole) == key(docs) and columns


def test_near_copies_are_met_in_the_tries_where_no_band_is_shared(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    texts += ["la li lu " * 400 + tail for tail in ("one two three four five six", "seven eight nine ten eleven twelve")]  # one print, other sets
    rows = []
    for k, text in enumerate(texts):
        found = nearcopies.shingles(text.encode())
        fp = struct.unpack("<q", struct.pack("<Q", simhash.fingerprint(text.encode())))[0]
        rows.append((nearcopies._node(found), k, k, [k], bytes(nearcopies.BANDS * nearcopies.ROWS), fp))  # a band of its own
    nodes = spark.createDataFrame(rows, "node long, low long, h long, bands array<long>, sketch binary, fp long")
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, h long, text string")
    node, fp = {k: r[0] for k, r in enumerate(rows)}, {k: r[5] % (1 << 64) for k, r in enumerate(rows)}
    near = {(i, j) for i in range(len(texts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2}
    met = {tuple(r) for r in nearcopies.trie_pairs(nodes).distinct().collect()}
    assert met == {tuple(sorted((node[i], node[j]))) for i, j in near}
    linked = {tuple(r) for r in nearcopies.links(nodes, docs).distinct().collect()}
    assert (81, 80) in near and len(near) > 10
    assert linked == {tuple(sorted((node[i], node[j]))) for i, j in near - {(81, 80)}}


def test_links_of_crowded_bands_are_written_in_few_parts(spark, monkeypatch):
    made, components_ = [], nearcopies.components
    monkeypatch.setattr(nearcopies, "components", lambda edges, **k: made.append(edges) or components_(edges, **k))
    docs = docs_of(spark, [(k, " ".join(f"w{k // 40}x{i}" for i in range(60)) + f" end{k}") for k in range(80)])
    assert sorted(r["doc_id"] for r in nearcopies.deduplicate(docs, page=2).collect() if r["doc_id"] is not None) == [0, 40]
    assert len(made) == 2  # of leaders with all, and of all
    for edges in made:
        assert edges.count() == edges.distinct().count() > 0
        assert edges.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_near_copies_stage_takes_the_tries(spark, monkeypatch):
    import corpus_pipeline as P

    called, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: called.append(1) or links(*a, **k))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i"), (4, "")], "doc_id long, text string")
    kept = P.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and called
