"""The operators against brute force, round trips and edge cases."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corvane.llm")

from corvane.llm import bpe, chat_format, decontam, html_extract, ngram_join, order_minhash, packing, sharding, token_counts, token_store, toxicity
from corvane.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    base = " ".join(words[i % 12] + str(i // 12) for i in range(60))
    rows = [(1, base, 0), (2, base.upper(), 0), (3, base.replace("alpha0", "changed"), 0), (4, None, 0), (5, "", 0), (6, "one two", 0), (7, "One\ttwo ", 0), (8, " ".join(f"w{i}" for i in range(5000)), 0), (9, base, 0), (10, "naïve café <|endoftext|> x  y\n z", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def library(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_library(docs):
    enc = bpe.encoder(tokenizer_path())
    for t in [*texts(docs).values(), " a  b", "x \ny", "a\n\n b  c\t d", "don't I'LL ''s", "é²½ x½2", "a\x1c b\x85 c\xa0 d  e", "  ", "12 34,5 a_b", "日本 語"]:
        assert enc.encode(t) == (enc.whole(t) if t else b"")


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\<|end|>[INST]"), (1, 1, "assistant", "</s>\\"), (1, 2, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.render(turns)).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"</s>\\").hexdigest() and got[1].loss_chars == 5
    assert got[2].n_turns == 2 and got[2].loss_chars == 2
    assert chat_format.read_back(chat_format.render(turns.limit(0))).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 0, "user", "hel", "append"), (1, 2, 0, "user", "lo", "append"), (1, 3, 1, "assistant", "bad", "append"), (1, 4, 1, "assistant", "", "regenerate"), (1, 5, 1, "assistant", "go", "append"), (1, 6, 1, "assistant", "od", "append"), (1, 7, 0, "user", "hi", "replace")]
    got = chat_format.fold_events(spark.createDataFrame(log, "conv_id long, seq long, turn long, role string, text string, op string"))
    assert {(r.turn, r.role, r.text) for r in got.collect()} == {(0, "user", "hi"), (1, "assistant", "good")}


def test_token_store(spark, docs, empty, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_token_store(docs, path, tokenizer_path(), partitions=3)
    got, start = {r.key: r for r in token_store.store_digests(spark, path).collect()}, 0
    for doc, text in sorted(texts(docs).items()):
        ids = library(text)
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_store.write_token_store(empty, str(tmp_path / "none"), tokenizer_path())
    assert token_store.store_digests(spark, str(tmp_path / "none")).count() == 0


def test_token_counts_and_cache(spark, docs, empty, tmp_path):
    cache = str(tmp_path / "cache")
    first = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path(), cache).collect()}
    assert first == {d: (len((t or "").encode()), len(library(t)) - 1) for d, t in texts(docs).items()}
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts(docs).values()})
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path(), cache).collect()} == first
    assert spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(empty, tokenizer_path(), cache).count() == 0


def test_toxicity(spark, docs, empty):
    lex = toxicity.Lexicon({f" {w} ": s for w, s in toxicity.BUILT_IN.items()})
    assert lex.score("you 1d10t and mоrоn") > 0.9 > 0.1 > lex.score("a quiet day") and lex.score(None) == lex.score("")
    assert lex.features("the trash can is full")[0] == 0 < lex.features("trash")[0]
    rows = [(i, f"plain words here number {i} " + ("zorgle fool" if i % 4 == 0 else "kind day"), 0, int(i % 4 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, extra int, toxic int")
    learned = toxicity.learn_lexicon(labelled.select("doc_id", "text", "toxic"))
    assert learned.score("what zorgle") > 0.7 > 0.3 > learned.score("kind day here")
    assert toxicity.score_texts(empty, lex).count() == 0 and toxicity.score_texts(docs, lex).count() == docs.count()


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, empty):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 8, 9, 100):
        assert [r.s for r in df.select(sharding.jump_shard(F.col("k"), n).alias("s")).collect()] == [jump(k % 2**64, n) for k in keys]
    rows = sharding.shard_rows(docs.union(docs)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r.slot)
        assert r.grown_shard in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == 20
    assert sharding.shard_rows(empty).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in sets}


def test_ngram_join(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows = [(r.doc_id, r.text, 0) for r in docs.collect()]
    for f in range(6):  # families of near copies, drifting so that only some pairs link
        words = [f"f{f}x{i}" for i in range(80)]
        for i in range(12):
            words[int(rng.integers(80))] = f"n{rng.integers(10**6)}"
            rows.append((1000 + 100 * f + i, " ".join(words), 0))
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {d: shingles(t) for d, t, _ in rows}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df.repartition(3)).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_decontamination(spark, empty):
    item = "A train leaves Paris at 12 and travels 340 km before noon while the second train departs later"
    bench = spark.createDataFrame([(0, item), (1, None), (2, "too short")], "item_id long, text string")
    slots = item.replace("12", "17").replace("340", "95").replace("Paris", "Lyon")
    rows = [(1, f"intro words {item} outro", 0), (2, slots, 0), (3, item.upper(), 0), (4, "nothing of the kind in this text at all", 0), (5, None, 0), (6, "", 0)]
    found = decontam.find_items(spark.createDataFrame(rows, SCHEMA), bench)
    assert {(r.doc_id, r["item"]) for r in found.collect()} == {(1, 0), (2, 0), (3, 0)}
    assert decontam.find_items(empty, bench).count() == 0 and decontam.find_items(spark.createDataFrame(rows, SCHEMA), bench.limit(0)).count() == 0


def test_items_of_mostly_slots_are_found_verbatim(spark, monkeypatch):
    items = [(0, "What is 12 * 7 + 5?"), (1, "Compute 17 * 23 + 4"), (2, "Name Oslo's fjord"), (3, "Xylophone"), (4, " ... "), (5, None), (6, "Sum 1 2 3 4 5 6 7 8 9 10 11 of apples pears plums figs and limes")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"he asked: {t}; so", 0) for i, t in items if t] + [(10, "What is 13 * 7 + 5?", 0), (11, "so WHAT IS 12 * 7 + 5", 0), (12, items[6][1].replace("11", "12"), 0), (13, "7 12 is what", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(0, 0), (1, 1), (2, 2), (3, 3), (6, 6), (11, 0), (12, 6)}
    assert {(r.doc_id, r["item"]) for r in decontam.find_items(docs, bench).collect()} == want
    said = {r["item"]: (r["words"], r.windows, r.templates) for r in decontam.search_of(bench).collect()}
    assert said == {0: (5, 1, 0), 1: (4, 1, 0), 2: (4, 1, 1), 3: (1, 1, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (19, 12, 4)}
    monkeypatch.setattr(decontam, "MAX_SET", 0)
    assert {(r.doc_id, r["item"]) for r in decontam.find_items(docs, bench).collect()} == want


def test_one_changed_slot_drops_its_own_windows_only(spark):
    item = "the road from Paris to the old coast runs past seven small farms and two wide rivers before it turns back towards Paris and ends there at the gate of a walled garden"
    first = item.replace("Paris", "Lyon")
    rows = [
        (1, item[::-1].replace("siraP", "noyL", 1)[::-1], 0),  # word for word but for the later mention
        (2, first[::-1].replace("noyL", "emoR", 1)[::-1], 0),  # every mention changed, the later otherwise
        (3, first, 0),
    ]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    found = {r.doc_id: (r.matched, r.windows) for r in decontam.find_items(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    n = len(item.split()) - 7
    assert set(found) == {1, 2, 3} and found[1] == found[3] == (n, n) and n / 2 < found[2][0] < n


def test_consistent_windows_of_an_alignment(spark):
    pair = lambda i, d: (i, d)
    sets = [[(1, False, [pair("a", "x")]), (2, False, [pair("a", "x"), pair("b", "y")]), (3, False, [pair("a", "z")]), (4, False, [pair("b", "y")])], [(1, False, [pair("a", "x")]), (2, False, [pair("b", "x")])], []]
    df = spark.createDataFrame([(s,) for s in sets], "w array<struct<item_at int, exact boolean, pairs array<struct<item_slots string, slots string>>>>")
    assert [sorted(d.item_at for d in r.k) for r in df.select(decontam._consistent("w").alias("k")).collect()] == [[1, 2, 4], [1, 2], []]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, docs, empty, rule):
    pieces = packing.cut_pieces(docs, tokenizer_path(), capacity=64)
    rows = packing.pack_best_fit(pieces, capacity=64, max_docs=4, rule=rule).collect()
    by, of = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        of[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64 and len(s) <= 4
    for doc, text in texts(docs).items():
        ids, at = np.array(library(text), "<u4"), 0
        for i, (piece, start, length, crc) in enumerate(sorted(of[doc])):
            assert (piece, start, crc) == (i, at, zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    assert packing.pack_best_fit(packing.cut_pieces(empty, tokenizer_path()), rule=rule).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(1)
    counts = dict(collections.Counter(rng.integers(1, 1025, 5000).tolist()))
    bins = max(b + -(-n // per) for _, _, n, b, per, _ in packing.plan_best_fit(counts))
    total = sum(k * v for k, v in counts.items())
    assert -(-total // 1024) <= bins <= 1.03 * total / 1024


def test_html():
    page = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><a href=x>m</a></nav><div class='cookie-notice'>ok?</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three</p><div class=comments>no</div><form>f</form></article><aside>s</aside><footer>&copy;</footer></body></html>"
    assert html_extract.extract_text(page) == "A & B\n\nOne two.\n\nThree"
    assert html_extract.extract_text(None) == html_extract.extract_text("") == "" and html_extract.extract_text("<article><p>cut off <b") == "cut off"
    long = "word " * 60
    assert html_extract.extract_text(f"<div><a href=a>x</a> <a href=b>y</a></div><div>{long}</div><p>{long}</p>").count("word") == 120


def test_html_marks_are_a_prior():
    long = "plain words of the story go on and on here " * 8
    page = f"<body><div><a href=a>one</a> <a href=b>two</a></div><article><p>{long}first</p><p>Short.</p></article><article><p>Brief note.</p></article><div><p>{long}outside</p><p>{long}more</p></div><div><a href=c>c</a> <a href=d>d</a></div><div><a href=e>e</a> <a href=f>f</a></div></body>"
    text = html_extract.extract_text(page)
    assert [t.split()[-1] for t in text.split("\n\n")] == ["first", "Short.", "note.", "outside", "more"]
    links = "".join(f"<p><a href=x{i}>see {i}</a></p>" for i in range(6))
    assert html_extract.extract_text(f"<main><p>{long}</p><p>{long}</p>{links}</main>").count("see") < 3


def test_order_minhash(spark, docs, empty):
    rows = {r.doc_id: r for r in order_minhash.fingerprint_edits(docs).collect()}
    order = sorted(texts(docs).items(), reverse=True)
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[doc].n_chars == len(text) and rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[doc].near_edited <= 1 and 0 <= rows[doc].near_next <= 1
    assert rows[1].fingerprint == rows[9].fingerprint != rows[3].fingerprint and rows[4].fingerprint == rows[5].fingerprint == ""
    assert order_minhash.fingerprint_edits(empty).count() == 0


def test_many_anchors_are_joined_with_the_same_result(spark, monkeypatch):
    said = "a farmer carries 12 kg of apples and 30 oranges towards the market before noon"
    docs = spark.createDataFrame([(1, f"well {said} then"), (2, "nothing of the kind is written here at all"), (None, said.replace("12", "17")), (3, None), (1, said)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, said)], "item_id long, text string")
    few = sorted(map(str, decontam.find_items(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MAX_SET", 0)
    assert sorted(map(str, decontam.find_items(docs, bench).collect())) == few
    assert len(few) == 2


def test_chunks_become_strings_together():
    import pyarrow as pa

    from corvane.llm import bpe

    for kind in (pa.string(), pa.large_string()):
        for chunks in ([], [""], ["", "a"], ["a", "", "é\n", "x,", "\t", "日本"]):
            assert bpe._strings(pa.array(chunks, kind)) == chunks
