"""The prefix trie, phrase mining and piece encoding on small tables, against brute force and the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickloom.llm import chunks, collocations, common, components, piece_bpe, prefix_trie

CONV = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- the trie of conversation prefixes


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda t: (*t[:3], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest())
    own = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:-1] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in ids if len(built[c]) == len(node))
        out.append((ids[0], len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, schema=CONV):
    got = prefix_trie.op11(spark, spark.createDataFrame(rows, schema))
    return sorted((tuple(r)[:8] for r in got.collect()), key=repr)


def talks(n=60, seed=4):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if rnd.random() < 0.1:
            continue
        start = rnd.choice([["hi"], ["hi", "yes"], []])
        turns = [*start, *(rnd.choice(["a", "bé", "", "hi", "c" * 40]) for _ in range(rnd.randint(0, 7)))]
        rows += [(c, k, rnd.choice(["user", "assistant"]) if k > 2 else "user", t) for k, t in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, piece", [(64, 4096), (2, 2)])
def test_trie(spark, monkeypatch, block, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = talks()
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_of_odd_rows(spark):
    odd = [(1, None, None, None), (1, None, "user", None), (1, 3, "user", ""), (None, 1, "user", "lost"), (2, 1, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "y"), (7, 0, "a:", "b"), (8, 0, "a", ":b"), (-3, 0, "user", "x"), (10**12, 5, "user", "long " * 20000)]
    wide = [(*r, 5, 6) for r in odd]
    assert trie_of(spark, wide, CONV + ", key int, pos int") == trie_by_hand(odd)
    assert trie_of(spark, []) == []


def test_trie_of_one_long_conversation_and_many_copies(spark):
    rows = [(5, k, "user", f"t{k % 7}") for k in range(400)] + [(c, k, "user", f"t{k % 7}") for c in range(100, 160) for k in range(3)] + [(400, k, "user", f"t{k % 7}") for k in range(300)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


# ---- phrases


def phrases_by_hand(rows, least, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p)))
        inner = any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items())
        out.append((lang, " ".join(p), len(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score, cut, inner))
    return sorted(out)


def prose(seed=5, n=60):
    rnd = random.Random(seed)
    words = ["Aa", "b", "çé", "dd", "E", "\x1cx", "new york", "as well as", "漢字", "z" * 300]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "; ", "\x0b"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 40)))
    rows = [(rnd.choice(["en", "de", None, "und", ""]), text()) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("de", " .,\t"), ("en", "a " * 3000), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("sent, places", [(1 << 20, 1 << 21), (40, 50), (1, 50)])
def test_phrases(spark, monkeypatch, sent, places):
    monkeypatch.setattr(collocations, "SENT", sent)
    monkeypatch.setattr(collocations, "HELD_PLACES", places)
    monkeypatch.setattr(collocations, "HELD_WORDS", places)
    rows = prose()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, id int, word string")
    assert sorted(map(tuple, collocations.collocations(df, least=4).collect())) == phrases_by_hand(rows, 4)


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.op12(spark, df).collect() == []
    assert collocations.op12(spark, spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []


def test_ranks_and_scores_past_64_bits(spark):
    rows = [("en", f"p{i:04} q", 2, 10**6 + i % 3, 1, 1, 10**9, i % 5, 1, False) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long, cut int, inner boolean")
    got = [(r["rank"], r.phrase) for r in collocations.best(df, 70).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (-r[7], -r[3], r[1]))[:70]
    assert got == [(i, r[1]) for i, r in enumerate(want, 1)]
    big = spark.sql("select cast(4000000000000 as long) a, cast(20000000000000 as long) n, cast(5000000000000 as long) l, cast(7000000000000 as long) r")
    wide = "cast({} as decimal(19, 0))".format
    assert big.selectExpr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) s").first().s == 1000 * 4 * 20 * 10**24 // (35 * 10**24)


# ---- pieces


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def processor(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


ODD = ["", " ", "  ", "▁", "a▁ b", "\n", "\x00\x1c", " lead", "trail ", "a" * 300, " " * 300, "ab" * 200 + " " * 40 + "x", "İßſ ﬁ 漢字 한 👍🏽 é́", "<s></s><unk><0x41>", "x².y", "1234.5e-6", "don't—“stop”…", "  ", "https://www.example.com/a?b=c&d=e"]


def test_pieces_equal_the_library(model, processor):
    bpe, cache = piece_bpe.coder(model)
    rnd = random.Random(8)
    letters = [*"aabceehilnorst  ▁\n\t.,0189ßé漢👍́", "the ", "ing", "   ", " " * 17, "ation", "<s>"]
    for text in ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]:
        ids = np.frombuffer(cache.ids([text])[0], "<u4").tolist()
        assert ids == processor.encode(text), text
        assert bpe.decode(ids) == processor.decode(ids), text
    for _ in range(4000):
        ids = [rnd.choice([0, 1, 2, 13, 130, 150, 200, 226, 228, 259, 29871, rnd.randrange(32000), rnd.randrange(3, 259)]) for _ in range(rnd.randint(0, 8))]
        assert bpe.decode(ids) == processor.decode(ids), ids


def test_backtracking_against_merging(model):
    """Each text merged as a whole, with no cuts into chunks."""
    bpe, _ = piece_bpe.coder(model)
    rnd = random.Random(9)
    for _ in range(500):
        text = "".join(rnd.choice("▁▁aeinrst.1漢") for _ in range(rnd.randint(1, 60)))
        assert bpe.tokens(text) == bpe.merged(text)


def test_encode_decode_pieces(spark, model, processor):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "same"), (3, "same"), (10**12, "word " * 50000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted((tuple(r) for r in piece_bpe.op13(spark, df, model).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = processor.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids))))
    assert got == sorted(want, key=repr)
    plain = {r.doc_id: r for r in piece_bpe.encode_decode(df.where("doc_id = 0 or doc_id = 12"), model).collect()}
    assert plain[0].n_tokens == 0 and plain[12].decoded == ODD[12]
    assert np.frombuffer(plain[12].ids, "<u4").tolist() == processor.encode(ODD[12])
    assert piece_bpe.op13(spark, spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_other_models_are_an_error(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2 as formats

    m = formats.ModelProto()
    m.ParseFromString(open(model, "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(tmp_path / "m"))


# ---- the cache of chunks


def test_a_cache_holds_no_more_than_its_bytes():
    made = []
    cache = chunks.ChunkCache(lambda cs: [made.append(c) or c * 3 for c in cs], most=20_000)
    for k in range(200):
        text = " ".join(f"w{k}x{i}" for i in range(20)) + " " + "長" * 1000 + str(k) + " again"
        assert cache.ids([text]) == [b"".join(c * 3 for c in text.encode().lower().split())]
        held = sum(len(a) + len(b) for d in (cache.young, cache.old) for a, b in d.items() if len(a) <= cache.KEEP)
        assert held <= 2 * (20_000 + 40 * 400) and len(cache.passing) == 1
    assert made.count(b"again") == 1


# ---- rows that were once lost or changed


def test_rows_without_an_id_link(spark):
    from tickloom.llm import jaccard_join

    rnd = random.Random(2)
    a, b = ([f"w{rnd.randrange(500)}" for _ in range(200)] for _ in range(2))
    near = lambda words, k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(7, " ".join(a)), (None, near(a, 199)), (None, " ".join(b)), (None, near(b, 199)), (3, near(b, 0))]
    got = jaccard_join.op8(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 3), (False, 7), (True, 3), (True, 3), (True, 7)]


def test_packed_ids_stay_whole_beside_a_null(spark):
    from tickloom.llm import packing

    rows = [(2**60 + k, 10, "s", k) for k in (1, 3, 5, 7)] + [(None, 10, "s", None)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and len({r.bin_id for r in got}) == 5


def test_huge_components_are_an_error(spark):
    from tickloom.llm import topk

    rows = [(0, [1.0, 2.0]), (1, [1e300, 0.5]), (2, [0.5, 0.5])]
    with pytest.raises(Exception, match="too large"):
        topk.op2(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


# ---- what the driver holds


def test_few_links_need_no_broadcast(spark):
    """The driver holds every broadcast: bounded edges have none, and the same least nodes as with hubs sent."""
    rnd = random.Random(9)
    edges = spark.createDataFrame([(u, v) for u, v in {(0, k) for k in range(1, 200)} | {(rnd.randrange(300), rnd.randrange(300)) for _ in range(300)} if u != v], "u long, v long")
    few, many = (components._with_least(edges, n) for n in (edges.count(), common.PLAIN + 1))
    assert "Broadcast" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.select("u", "v", "m").collect())) == sorted(map(tuple, many.select("u", "v", "m").collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_few_rows_are_joined_plainly(spark, how):
    rows = spark.createDataFrame([(k % 7 or None, k) for k in range(40)], "k long, v long")
    side = spark.createDataFrame([(k, -k) for k in (1, 2, 3, 9)], "k long, w long")
    plain, heavy = (common.join_heavy(rows, side, "k", how, most) for most in (40, 39))
    assert "broadcast" in heavy._jdf.queryExecution().analyzed().toString() and "broadcast" not in plain._jdf.queryExecution().analyzed().toString()
    assert sorted(map(repr, plain.select("k", "v", "w").collect())) == sorted(map(repr, heavy.select("k", "v", "w").collect()))
