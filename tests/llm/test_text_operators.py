"""Operators on small tables against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import chat, decontam, jaccard, licences, media, packing, quality, registry, sharding, suffixes, urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = ["Alpha", "beta", "gamma", "é", "delta,", "x" * 12, "of", "the"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(120)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "one two"), (6, "a" * 400), (7, "b " * 300)]
    for k in range(40):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 20])):
            t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
        rows.append((100 + 7 * k % 97 + 100 * (k % 3), " ".join(t)))
    rows = list(dict(rows).items())
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, shard double")
    return df.repartition(3), dict(rows)


def empty(df):
    return df.where("doc_id < 0")


def test_sharding(docs):
    df, texts = docs
    rows = sharding.shard_by_bytes(df, 4).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    shard_of = {}
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
    for k in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert sharding.shard_by_bytes(empty(df), 4).count() == 0


def _sets(texts):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return out


def _components(texts):
    sets = _sets(texts)
    name = {d: d for d in sets}

    def find(d):
        while name[d] != d:
            d = name[d]
        return d

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("frequent", [6, 1])
def test_jaccard(docs, monkeypatch, frequent):
    df, texts = docs
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df).collect()}
    assert got == _components(texts)
    assert jaccard.similar_groups(empty(df)).count() == 0


def _removed(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"slab": 200}])
def test_suffix_dedup(docs, options):
    df, texts = docs
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeats(df, **options).collect()}
    assert got == _removed(texts)


def test_suffix_dedup_edges(docs, spark):
    df, _ = docs
    assert suffixes.repeats(empty(df)).count() == 0
    twice = spark.createDataFrame([(1, "q" * 50 + "w" * 90), (1, "q" * 50 + "w" * 90), (None, "z" * 30)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.repeats(twice).collect())
    assert rows == [(0, 0), (1, 0), (1, 0)]
    kept = suffixes.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == df.count()


def test_suffixes_many_texts_of_one_key(spark):
    """More different texts without a key than a short can number."""
    rng = random.Random(6)
    passage = " " + "".join(rng.choice("abcdefghij") for _ in range(118)) + " "
    own = F.col("id").cast("string")
    rows = spark.range(33_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id").isin(5, 32_999), F.concat(own, F.lit(passage), own)).otherwise(own).alias("text"))
    got = [(r["doc_id"], r["n_removed"]) for r in suffixes.repeats(rows).collect()]
    assert len(got) == 33_000 and all(d is None for d, _ in got) and sorted(n for _, n in got)[-2:] == [0, 120]
    assert suffixes.without_repeats(rows).agg(F.count("*"), F.sum(F.length("text"))).first() == (33_000, sum(len(str(k)) for k in range(33_000)) + 1 + 5 + 120)


def test_decontamination(docs, spark):
    df, texts = docs
    known = texts[max(texts)].split(" ")
    bench = spark.createDataFrame([(10, " ".join(known[5:30])), (11, "ONE, two"), (12, None), (None, "..."), (13, "absent words here")], "item_id long, text string")
    for size in (decontam.BLOCK_BYTES, 20):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(df, bench, block_bytes=size).collect()}
        assert got[4] == (2, 2, ["11"]) and got[1] == (0, 0, []) and "10" in got[max(texts)][2]
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and left.where("doc_id = 4").count() == 0 and left.where("doc_id = 6").count() == 1
    assert decontam.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_packing(docs):
    df, _ = docs
    rows = packing.pack(packing.tokenize(df, 64), 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(packing.tokenize(empty(df))).count() == 0


def test_quality(docs, spark):
    df, _ = docs
    rng = random.Random(8)
    plain = "the river was calm and people walked home along old roads while birds sang over green fields near small towns where many friends met each evening to talk about work weather music books or plans for spring".split()
    good = [" ".join(rng.choice(plain) for _ in range(60)).capitalize() + ". The end came soon." * 4 for _ in range(60)]
    bad = ["BUY!! NOW!! CHEAP!! " * 20, "word### other*** thing$$$ " * 20, "same same same same " * 30]
    more = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad * 5)], "doc_id long, text string")
    rows = quality.classify(more).collect()
    assert all(r["keep"] for r in rows if r["doc_id"] < 60) and not any(r["keep"] for r in rows if r["doc_id"] >= 60)
    out = quality.classify(df)
    assert out.where("doc_id in (1, 2, 3, 4) and not keep").count() == 0 and out.count() == df.count()
    assert quality.classify(empty(df)).count() == 0


def test_quality_agrees_with_labels(spark, small):
    rows = registry.QUERIES["op4_quality"](spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_licences(docs, spark):
    rows = spark.createDataFrame([(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "He renewed his license."), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["licences"]] for r in licences.scan(rows).collect()}
    assert got == {1: [(1, "mit")], 2: [(0, "gpl-3.0")], 3: [], 4: [], 5: []}
    assert licences.scan(empty(docs[0])).count() == 0


def test_licences_inside_long_and_wrapped_paragraphs(spark):
    """Every template is found once, within hundreds of words and wrapped over two lines."""
    rng = random.Random(3)
    plain = [w for t in licences.PLAIN for w in t.split() if w.isalpha()] + "river walked home along old roads while birds sang over green fields near small towns".split()
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    cases = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    rows, want = [], {}
    for family, notice in cases:
        words = notice.split()
        for text, paragraph in (
            (f"{prose(400)} {notice} {prose(300)}", 0),
            (f"{prose(5)}\n{prose(250)} {notice}\n\n{prose(9)}", 1),
            ("\n".join([prose(20), "", " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :]), "", prose(20)]), 2),
        ):
            # the second half of this one is a notice by itself
            want[len(rows)] = (3 if paragraph == 2 and notice.startswith("Copyright 2020") else paragraph, family)
            rows.append((len(rows), text))
    rows += [(len(rows) + k, prose(500)) for k in range(20)]
    rows.append((len(rows), "Licensed under\n\nthe ISC License"))
    both = len(rows)
    rows.append((both, f"{prose(200)} Licensed under the ISC License {prose(200)} All rights reserved. {prose(100)}"))
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["licences"]] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == {k: [v] for k, v in want.items()}
    assert all(not got[k] for k in range(len(want), both)) and sorted(got[both]) == [(0, "all-rights-reserved"), (0, "isc")]


def test_media(docs):
    df, texts = docs
    for r in media.media_columns(df, arrays=True).collect():
        t = (texts[r["doc_id"]] or "").encode()
        payload = media.padded(t)
        assert r["n_bytes"] == len(t) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and media.from_wav(r["media"]) == payload
        assert len(r["fp_time"]) == len(r["fp_code"])


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a<|end|>\\n\\\\ b"},{"role":"assistant","content":"c\\\\l"}]}'),
        (2, '{"prompt":"p","response":"r"}'),
        (3, '{"instruction":"i","input":"","output":"o"}'),
        (4, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}'),
        (5, '{"other":1}'),
        (6, "not json"),
        (7, None),
    ]
    out = chat.format_records(spark.createDataFrame(records, "id int, record string")).withColumn("back", chat.parse(F.col("formatted")))
    got = {r["id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out.collect()}
    assert got[1] == [("user", "a<|end|>\n\\ b"), ("assistant", "c\\l")]
    assert got[2] == [("user", "p"), ("assistant", "r")] and got[3] == [("user", "i"), ("assistant", "o")] and got[4] == [("user", "h"), ("assistant", "g")]
    assert got[5] == got[6] == got[7] == []


def test_chat_records_leave_clashing_columns(spark):
    """Columns of other names stay, those of the added names are replaced; repeated, null and no rows."""
    record = '{"prompt":"p","response":"r"}'
    rows = [(1, record, "v", "w", "f"), (1, record, "v", "w", "f"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, record string, _v string, __v string, turns string")
    out = chat.format_records(df)
    assert out.columns == ["id", "record", "_v", "__v", "turns", "fingerprint", "formatted", "loss_spans"]
    got = sorted((r["id"] or 0, r["_v"], r["__v"], [t["text"] for t in r["turns"] or ()], r["formatted"], len(r["loss_spans"])) for r in out.collect())
    text = "<|role|>user\np<|end|>\n<|role|>assistant\nr<|end|>\n"
    assert got == [(0, None, None, [], "", 0)] + [(1, "v", "w", ["p", "r"], text, 1)] * 2
    assert chat.format_records(df.where("id > 9")).count() == 0


def test_empty_tables(spark, docs, tmp_path):
    """Media columns, URLs, chats and every stage of the pipeline give an empty result for an empty table."""
    none = empty(docs[0])
    assert media.media_columns(none, arrays=True).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), urls.train(spark)).count() == 0
    assert chat.format_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    spark.createDataFrame([(1, "absent words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns), name


def test_chat_long_texts(spark, tmp_path):
    """Texts over the JSON parser's limit of 20 million characters come through whole, or fail."""
    long = F.concat(F.lit("<"), F.repeat(F.lit("a\\"), 10_050_000), F.lit("b"))
    rows = spark.sql("SELECT * FROM VALUES (1L, 0L, 'user', 'x'), (1L, 1L, 'assistant', null), (2L, 0L, 'human', 'y') t(conv_id, turn, role, text)")
    rows = rows.withColumn("text", F.when((F.col("conv_id") == 1) & (F.col("turn") == 1), long).otherwise(F.col("text")))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    text = "<" + "a\\" * 10_050_000 + "b"
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, len(text)) and got[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[2]["n_turns"] == 1 and got[2]["turns_sha256"] == hashlib.sha256(b"human\ny\n").hexdigest()
    record = spark.range(1).select(F.concat(F.lit('{"prompt":"p","response":"'), F.repeat(F.lit("r"), 20_100_000), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="MALFORMED_RECORD|VARIANT_SIZE|parse"):
        chat.format_records(record).select(F.length("formatted")).collect()


def test_urls(spark):
    rows = ["https://A.Example.com/en/75?x#y", "http://b.com/en/1", "ftp://x.example.net/de/8", "no scheme", None, "https://free-casino-online.example.org/win/bonus", "http://example.org", "x://org/es/"]
    out = urls.filter_urls(spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string"), urls.train(spark))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[0] == ("a.example.com", "/en/75", "example.com/en/7", "allow")
    assert got[1] == ("b.com", "/en/1", "com/en/", "block") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][3] == "block" and got[6][:3] == ("example.org", "", None) and got[7][2] == "org/es/"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, small, name):
    assert oracle.differences(registry.QUERIES[name](spark, small), oracle.connect(small), registry.ORACLES[name]) == ""


def test_pipeline(docs, spark, tmp_path):
    df, texts = docs
    known = texts[max(texts)].split(" ")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, " ".join(known[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, left = df, texts
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        rows = at.collect()
        if name == "near_duplicates":
            assert {r["doc_id"] for r in rows} == {d for d, (_, c) in _components(left).items() if c == d}
        if name == "repeats":
            for r in rows:
                assert hashlib.sha256(r["text"].encode()).hexdigest() == _removed(left)[r["doc_id"]][3] and r["n_chars"] == len(r["text"])
        if name != "packing":
            assert at.columns == df.columns
            left = {r["doc_id"]: r["text"] for r in rows}
            at = spark.createDataFrame(rows, df.schema)
    assert {r["doc_id"] for r in rows} == set(left)


def _near_group(count, words, changes, seed):
    """Texts that differ from one text in a few words, about as far from one another as links reach."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = {}
    for d in range(count):
        t = list(base)
        for _ in range(rng.randint(*changes)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out[3 * d + 1] = " ".join(t)
    return out


@pytest.mark.parametrize("held,least", [(200_000, 100), (6_000, 100)])
def test_jaccard_of_a_large_group_at_the_threshold(spark, monkeypatch, held, least):
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "LEAST", least)
    texts = _near_group(400, 80, (2, 5), 11) | {5000 + d: t for d, t in _near_group(300, 150, (4, 6), 12).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df).collect()}
    want = _components(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 690


def test_jaccard_compares_bytes_and_keys(spark):
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    x, y = ("".join(s[b] for b in bits) for s in ("ab", "ba"))
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, x), (2, y), (3, x), (4, long), (5, long + " end"), (6, "a b c d e f"), (6, "q r s t u v"), (7, "q r s t u v"), (8, "A b c d e f"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.similar_groups(df).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 1), (4, 4), (5, 4), (6, 6), (6, 6), (7, 6), (8, 6)]


def test_decontamination_leaves_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = [(1, "x A B C D E F G H I J y", "own", 5, "t"), (2, "clean words", "mine", 6, "u"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, body string, items string, n_hit int, text string")
    left = decontam.decontaminate(df, bench, text="body")
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[2]], key=str)
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["text"], r["spans"]) for r in decontam.scan(df, bench, text="body").collect()}
    assert got[1][:3] == (10, ["1"], "t") and [tuple(x) for x in got[1][3]] == [(1, 11)] and got[2][:3] == (0, [], "u")


def test_decontamination_of_long_and_repeated_items(spark):
    """Pieces of a long item, copies of one text and blocks of any size give what one set gives."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(50)}" for _ in range(3000)]
    items = [(1, " ".join(long)), (2, "short item"), (3, "short item"), (3, "short item"), (4, " ".join(long[70:95]))] + [(100 + k, f"item number {k} of many words in a row with tail {k}") for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, " ".join([*(f"v{rng.randrange(9)}" for _ in range(20)), *long[a : a + n], "Short ITEM" if k % 3 else "", "item number 7 of many words in a row with tail 7" if k % 5 == 0 else ""])) for k, (a, n) in enumerate((rng.randrange(2900), rng.choice([0, 9, 10, 40])) for _ in range(30))]
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))

    want = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, text in items:
            v = words(text)
            n = min(len(v), 10)
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    for size in (decontam.BLOCK_BYTES, 400):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(df, bench, block_bytes=size).collect()}
        assert got == want


def test_sharding_has_the_least_capacity(spark):
    rng = random.Random(4)
    texts = ["", None, "same"] + [rng.choice("abcdef") * rng.randrange(200) for _ in range(150)]
    df = spark.createDataFrame([(None if k % 9 == 0 else k % 40, t, "x") for k, t in enumerate(texts * 3)], "doc_id long, text string, size string")
    out = sharding.shard_by_bytes(df, 5)
    rows = out.collect()
    sizes = {}
    for r in df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).collect():
        sizes[r["h"] % (1 << 64)] = sizes.get(r["h"] % (1 << 64), 0) + r["n"]
    capacity, _ = sharding.minimax([sizes[h] for h in sorted(sizes)], 5)
    loads = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(5)]
    assert max(loads) == capacity and len(rows) == len(texts) * 3
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows))) for k in range(5))


def test_packing_against_the_tokenizer(spark, small):
    """Every piece of all documents, with ids of an untouched tokenizer."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        whole = len(ids) <= 1024
        for piece, (a, b) in enumerate([(0, len(ids))] if whole else zip(cut[:-1], cut[1:], strict=True)):
            want[d["doc_id"], piece] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    rows = registry.QUERIES["op2_packing"](spark, small).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_urls_on_held_out_hosts(spark):
    """Every fifth host is held out in turn: its words, and for most unwanted URLs a plain path, were never seen.

    Far above the share of the larger class (0.73); README has the figure.
    """
    rows = urls.labelled()
    host = lambda u: u.split("://")[1].rsplit(".example", 1)[0]
    hosts = sorted({host(u) for u, _ in rows})
    right = 0
    for fold in range(5):
        away = set(hosts[fold::5])
        weights = urls.train(spark, [r for r in rows if host(r[0]) not in away])
        held = spark.createDataFrame([r for r in rows if host(r[0]) in away], "url string, label int")
        right += sum((r["verdict"] == "block") == r["label"] for r in urls.filter_urls(held, weights, []).collect())
    print("held-out accuracy", right / len(rows))
    assert right / len(rows) > 0.8


def test_urls_of_repeated_long_and_clashing_rows(spark):
    rows = [(1, "https://free-casino-online.example.org/" + "a" * 50_000, "mine", "own"), (1, "https://news.example.com/en/1", "mine", "own"), (1, "https://news.example.com/en/1", "mine", "own")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, other string"), urls.train(spark)).collect()
    assert len(out) == 3 and {r["other"] for r in out} == {"own"} and out[1]["host"] == "news.example.com" and out[1] == out[2] and len(out[0]["path"]) == 50_001


def test_licences_by_identifier_and_in_other_words(spark):
    """Held-out wordings: identifiers in comments, notices with words changed or dropped, wrapped ones; and none in prose."""
    rng = random.Random(12)
    rows, want = [], {}
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            for _ in range(4):
                words = notice.split()
                # a word that names no family goes; with any word dropped, 162 of 184 were found
                small = [k for k, w in enumerate(words[:-1]) if w.lower() in "the this is of to under by be any in or and a".split()]
                if len(words) > 5 and small:
                    words.pop(rng.choice(small))
                text = "// " + " ".join(words) + rng.choice(["", " See the file for details.", "\nint main() {}"])
                want[len(rows)] = family
                rows.append((len(rows), text))
    got = {r["doc_id"]: {x["family"] for x in r["licences"]} for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[k] in got[k] for k in want) / len(want) >= 0.9
    assert sum(bool(got[k] - {want[k]}) for k in want) / len(want) <= 0.1
    odd = [(None, "x\nSPDX-License-Identifier: MIT", "a"), (1, "word " * 20_000 + "Licensed under the ISC License", "b"), (1, None, "c"), (1, None, "c")]
    seen = licences.scan(spark.createDataFrame(odd, "doc_id long, text string, licences string")).collect()
    assert len(seen) == 4 and sorted(str([x["family"] for x in r["licences"]]) for r in seen) == ["['isc']", "['mit']", "[]", "[]"]


def test_media_features_are_recomputed(docs):
    """Digest and arrays against a plain transform of each frame; equal texts have equal values."""
    df, texts = docs
    seen = {}
    for r in media.media_columns(df, arrays=True).collect():
        when, code = media.fingerprints(__import__("numpy").frombuffer(media.padded((texts[r["doc_id"]] or "").encode()), "uint8"))
        assert (r["fp_time"], r["fp_code"]) == (when.tolist(), code.tolist()) and r["feature"].startswith(f"{len(code)}:")
        row = tuple(r[c] for c in ("n_bytes", "payload_sha256", "media_sha256", "feature"))
        assert seen.setdefault(texts[r["doc_id"]] or "", row) == row


def test_stages_leave_clashing_columns(spark, tmp_path):
    words = "the river was calm and people walked home along old roads while birds sang".split()
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(50)), "en", f"v{k}", k, 0.25, "p", False) for k in range(12)]
    schema = "doc_id long, text string, lang string, votes string, n_hit int, score double, component_id string, keep boolean"
    df = spark.createDataFrame(rows + rows[:2] + [(None, None, None, None, None, None, None, None)], schema)
    spark.createDataFrame([(10, "absent words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert out.columns == df.columns, name
        want = sorted((tuple(r) for r in df.collect()), key=str)
        assert [g[2:] for g in got] == [w[2:] for w in want], name


def test_packing_of_rows_without_key(spark):
    """Copies without a key, of one length, fill sequences without gaps."""
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same words here")).otherwise(F.lit(None)).alias("text"), F.lit("x").alias("rank"))
    rows = packing.pack(packing.tokenize(df, 16), 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 5000 and all([a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 16 for v in by.values())
    assert len(by) <= -(-sum(r["length"] for r in rows) // 16) * 1.1 + 1
