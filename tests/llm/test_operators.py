"""The ten operators against plain versions, on a small fixture with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, classifier, packing, pii, quality, simhash, spotsigs, substring, token_files
from sparkloom.llm.byte_tokens import ByteTokens
from sparkloom.llm.common import scratch

R = random.Random(5)
WORDS = ["the", "of", "and", "der", "la", "Alpha", "beta,", "gamma.", "Delta", "epsilon", "zeta", "eta", "theta", "été", "naïve", "漢字", "x1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, __lines string, range int"


def _text(n):
    return "".join(R.choice(WORDS) + R.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def _rows():
    shared, base = _text(40), _text(120)
    texts = [base, base, base + " tail", None, "", " \n\t ", "one", "two words", shared, "start " + shared + " end", _text(4000), "a " * 3000, "x" * 5000, "|| ## $$", "mail me.x@host.example.com or +1 (663) 555-6869", "4465758382889437 and 188.54.39.104", "call (499) 555-6503 now", "<|endoftext|> in text", "\\<|end|> ok", "line one\nline two\nline one"]
    texts += [_text(R.randint(5, 80)) for _ in range(20)] + [base + " " + R.choice(WORDS) for _ in range(5)]
    rows = [(i * 3, t, "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", i) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def path():
    import public_tokenizers as P

    return P.path


def h(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def with_null_id(docs):
    return docs.unionByName(docs.where("doc_id = 0").limit(1).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("hot", [1, 64])
def test_simhash(docs, empty, plain, hot):
    got = {r.doc_id: r for r in simhash.near_groups(docs, hot=hot).collect()}
    fp = {i: simhash.fingerprint_of(t) for i, t in plain.items()}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    near = {i: len({f for f in fp.values() if f != fp[i] and (f ^ fp[i]).bit_count() <= 2}) for i in fp}
    assert {i: (f"{fp[i]:016x}", find(i), near[i]) for i in fp} == {i: (r.fingerprint, r.component_id, r.n_links) for i, r in got.items()}
    assert simhash.near_groups(empty).count() == 0
    assert fp[9] == fp[12] == 0
    again = simhash.near_groups(with_null_id(docs.unionByName(docs)), hot=hot)
    assert again.count() == 2 * len(plain) + 1


def test_simhash_keeps_one_row(spark, docs, empty, plain):
    """Repeated ids: the row that copies another goes, the row of the same id that is unique stays, always the same."""
    w = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, w, "b"), (2, w, "a"), (2, "quite another text with other words in it altogether now", "a"), (None, w, "a"), (None, "a third text that only a row without an id has got", "a"), (1, w, "a"), (7, None, "z"), (5, "", "y")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keep in (simhash.keep_one, simhash.keep_one_alike):
        for parts in (1, 5):
            got = {tuple(r) for r in keep(given.repartition(parts)).collect()}
            assert got == {(1, w, "a"), rows[2], rows[4], (5, "", "y")}
        assert keep(empty).count() == 0 and keep(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [1, 8, 64])
def test_simhash_lists_all_links_of_crowded_segments(spark, hot):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(20)}
    for b in list(fps)[:5]:
        for _ in range(60):
            x = b
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randint(0, 63)
            fps.add(x)
    b, bits = min(fps), [r.randint(0, 63) for _ in range(7)]
    for m in range(1 << 7):
        fps.add(b ^ sum({1 << k for i, k in enumerate(bits) if m >> i & 1}))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted(map(signed, fps))
    want = sorted((a, c) for a in fps for c in fps if a < c and ((a ^ c) & (1 << 64) - 1).bit_count() <= 2)
    assert sorted((x.a, x.b) for x in simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot).collect()) == want


def test_simhash_stage_takes_jaccard(spark):
    """Near copies many bits apart go, and texts under the threshold stay."""
    import corpus_pipeline

    r = random.Random(11)
    texts = []
    for n in [150, 200, 300, 400, 600, 800] * 3:
        w = [f"w{r.randint(0, 5000)}" for _ in range(n)]
        for rate in (0, 0.005, 0.01, 0.015, 0.02, 0.04):
            texts.append(" ".join(f"v{r.randint(0, 5000)}" if r.random() < rate else x for x in w))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root, far = list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                far += bin(simhash.fingerprint_of(texts[a]) ^ simhash.fingerprint_of(texts[b])).count("1") > 2
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert far > 50
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, given, None)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_fingerprint_bits():
    import xxhash

    w = "The quick  brown fox\njumps".lower().split()
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    want = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) * 2 > len(shingles):
            want |= 1 << bit
    assert simhash.fingerprint_of("The quick  brown fox\njumps") == want


def test_quality(docs, empty, plain):
    got = {r.doc_id: r for r in quality.quality_rules(docs, max_docs=3).collect()}
    lines = defaultdict(lambda: defaultdict(set))
    host = {r.doc_id: r.source or "" for r in docs.collect()}
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    worded = lambda t: [x for x in t.split("\n") if x.encode().split()]
    for i, t in plain.items():
        for x in worded(t):
            lines[host[i]][norm(x)].add(i)
    for i, t in plain.items():
        w = t.encode().split()
        grams = defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        cover = {k + j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(5)}
        gone = [x for x in worded(t) if len(lines[host[i]][norm(x)]) > 3]
        r = got[i]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        lost = sum(len(x.encode().split()) for x in gone)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(len(x.decode()) for x in w), len(re.findall("[#*$%&|<>]", t)), len(worded(t)) - len(set(worded(t))), len(cover), failed), i
        assert (r.n_lines_removed, r.n_words_removed, r.kept) == (len(gone), lost, not failed and len(w) - lost >= 0.3 * len(w)), i
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_rules(with_null_id(docs.unionByName(docs))).count() == 2 * len(plain) + 1
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in {x.doc_id: x for x in quality.quality_rules(docs, keep_first=True).collect()}.items() if r.kept}


def test_quality_counts_documents_not_rows(spark):
    """A document stored sixty times is one; rows of one id are judged each by its own text, and equal rows alike."""
    line = "a line that stands in the footer of this site"
    rest = lambda i: "one two three four five six seven eight nine ten number" + str(i)
    rows = [(1, f"{line}\n{rest(i)}", "h") for i in range(60)] + [(2, f"{line}\n{rest(0)}", "h")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 61 and {r.n_lines_removed for r in got} == {0}
    rows += [(i, f"{line}\n{rest(i)}\n{line}", "h") for i in range(3, 60)] + [(3, f"{rest(3)} and more", "h"), (4, f"{line}\n{rest(4)}\n{line}", "h"), (None, line, "h")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for first in (False, True):
        got = quality.quality_rules(given, keep_first=first).collect()
        assert len(got) == len(rows)
        removed = sorted((r.doc_id or 0, r.n_words, r.n_lines_removed) for r in got)
        want = sorted((i or 0, len(t.split()), 0 if first and i == 1 else t.count(line)) for i, t, _ in rows)
        assert removed == want
        assert [r.kept for r in got if r.doc_id is None] == [False]


def test_token_files(spark, docs, empty, plain, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = scratch(spark, "orc-test")
    token_files.write_token_files(docs, out, path("byte_bpe_50k.json"), files=4)
    got = {r.doc_id: r for r in token_files.token_digests(spark, out).collect()}
    start = 0
    for i in sorted(plain):
        ids = np.array(t.encode(plain[i], add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_token_files(spark, out).where("doc_id = 30").count() == 1
    out = scratch(spark, "orc-empty")
    token_files.write_token_files(empty, out, path("byte_bpe_50k.json"))
    assert token_files.token_digests(spark, out).count() == 0
    out = scratch(spark, "orc-null")
    token_files.write_token_files(with_null_id(docs.unionByName(docs)), out, path("byte_bpe_50k.json"), files=4)
    assert token_files.token_digests(spark, out).count() == 2 * len(plain) + 1


def test_token_files_start_cuts_repeated_ids(spark, path):
    """Rows of one id with different texts, over one file and several: all ids in the order of the files, cut at start."""
    texts = ["one text of some length that repeats an id", "two", "three words here", "two", ""]
    docs = spark.createDataFrame([(i % 4, texts[i % 5] + " x" * (i % 3)) for i in range(60)], "doc_id long, text string")
    seen = []
    for files, parts in ((1, 3), (5, 7)):
        out = scratch(spark, "orc-repeats")
        token_files.write_token_files(docs.repartition(parts), out, path("byte_bpe_50k.json"), files=files)
        rows = token_files.read_token_files(spark, out).select("doc_id", "ids", "place", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("file")).orderBy("file", "place").collect()
        assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
        stream = np.array([x for r in rows for x in r.ids], "<u4")
        got = token_files.token_digests(spark, out).collect()
        for r in got:
            assert zlib.crc32(stream[r.start : r.start + r.n_tokens].tobytes()) == r.ids_crc32
        assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)
        seen.append(sorted(map(tuple, got)))
    assert seen[0] == seen[1]  # however the table is split


def test_token_files_follow_numbers(spark, path):
    """From 100000 files on names have a digit more, and the order is still that of the numbers."""
    names = ["part-99999-a.orc", "part-100000-a.orc", "part-00007-part-1.orc"]
    rows = spark.createDataFrame([(n,) for n in names], "file string").select("file", token_files.file_number(F.col("file")).alias("n"))
    assert [r.n for r in rows.orderBy("n").collect()] == [7, 99999, 100000]
    out = scratch(spark, "orc-order")
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(60)], "doc_id long, text string")
    token_files.write_token_files(docs, out, path("byte_bpe_50k.json"), files=3)
    from pathlib import Path

    for p in sorted(Path(out.removeprefix("file:")).glob("part-*.orc")):
        at = int(p.name.split("-")[1])
        p.rename(p.with_name(p.name.replace(f"part-{at:05d}", f"part-{99998 + at}")))
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    got = {r.doc_id: r for r in token_files.token_digests(spark, out).collect()}
    start = 0
    for i in range(60):
        assert got[i].start == start
        start += got[i].n_tokens


def test_token_files_prune(spark, path):
    """A file carries a Bloom filter of its ids and several stripes that are read apart; a lookup reads few rows."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(2 * i, " ".join(r.choice(words) for _ in range(40))) for i in range(20000)], "doc_id long, text string")
    out, old = scratch(spark, "orc-prune"), dict(token_files.ORC)
    try:
        token_files.ORC["orc.stripe.size"] = str(1 << 20)
        token_files.write_token_files(docs, out, path("byte_bpe_50k.json"), files=1)
    finally:
        token_files.ORC.update(old)
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    from pathlib import Path

    (file,) = [str(p) for p in Path(out.removeprefix("file:")).glob("part-*.orc") if p.stat().st_size > 1000]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 2000 and reader.getStripes().size() > 1
    rows = reader.rows()
    streams = {str(s.getKind()) for s in rows.readStripeFooter(reader.getStripes().get(0)).getStreamsList() if s.getColumn() == 1}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= streams
    rows.close()
    reader.close()

    # the scan's own count of rows: of one row group at most for an id that is there, of none for one that is not
    for wanted, most in ((20002, 2000), (20003, 0)):
        df = token_files.read_token_files(spark, out).where(f"doc_id = {wanted}")
        df.collect()
        assert _scanned(df) <= most
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        parts = token_files.read_token_files(spark, out).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(x["count"] > 0 for x in parts) > 1


def _scanned(df) -> int:
    """Rows that the file scan of an executed plan put out."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("Scan"):
            total += p.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_byte_tokens_odd_texts(path):
    b = ByteTokens(path("byte_bpe_50k.json"))
    alpha = ["a", "the", "'s", "'ll", "é", " ", "  ", "   ", "\n", "\n\n", "\t", "\xa0", "1", "23", "!", "<|endoftext|>", "漢字", "x́", "\x1c", " \n", "Σ", "​", "😀", "\0", "", " "]
    r = random.Random(1)
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    ids, at = b.encode(texts, 7)
    for t, x, y in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[x:y].tolist() == b.tokenizer.encode(t, add_special_tokens=False).ids + [7]


def test_packing(docs, empty, plain, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, path("byte_bpe_50k.json"))
    rows = packing.piece_digests(pieces).collect()
    want = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in plain.items()}
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        cover[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, n in sorted(cover[i]):
            assert start == at
            at += n
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty, path("byte_bpe_50k.json")).count() == 0


def test_best_fit_matches_plain_search():
    """Over several blocks, with and without a bound on open windows, as a plain search through all open windows."""
    r = random.Random(2)
    for trial in range(40):
        most = [10**9, 5][trial % 2]
        packer, plain, shut, got = packing.Packer(100), [], [], []
        for _ in range(r.randint(1, 4)):
            lengths = [r.randint(1, 100) for _ in range(r.randint(0, 80))]
            placed = packer.block(lengths)
            for n, (w, offset) in zip(lengths, placed, strict=True):
                assert 0 <= offset <= 100 - n
            for n in sorted(lengths, reverse=True):
                fits = [f for f in plain if f + n <= 100]
                if fits:
                    plain[plain.index(max(fits))] += n
                else:
                    plain.append(n)
            fill = dict(packer.fill)
            got += [fill[w] for w in packer.closed(most)]
            shut += [f for f in plain if f == 100]
            plain = sorted(f for f in plain if f < 100)
            while len(plain) > most:
                shut.append(plain.pop())
            assert sorted(got) == sorted(shut) and sorted(packer.fill.values()) == plain
        fill = dict(packer.fill)
        assert sorted(fill[w] for w in packer.closed()) == plain and not packer.fill


def test_packing_carries_open_windows(docs, path):
    """Small blocks leave no more windows than one block does, and repeated and null ids are packed each with its text."""
    one = docs.coalesce(1)
    count = lambda **k: packing.pack_documents(one, path("byte_bpe_50k.json"), **k).select("sequence_id").distinct().count()
    assert count(block=3) <= count() + 1
    both = docs.unionByName(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" again")))).unionByName(with_null_id(docs).where("doc_id IS NULL"))
    rows = packing.pack_documents(both, path("byte_bpe_50k.json"), block=7).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted(tuple(t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in both.collect())
    assert sum(r.length for r in rows) == sum(map(len, want)) and sorted(r.doc_tokens for r in rows if r.start == 0) == sorted(map(len, want))
    short = [w for w in want if len(w) <= 2048]
    assert sorted(tuple(r.ids) for r in rows if r.doc_tokens <= 2048) == short


def test_pii_base_and_field(docs, empty, plain):
    field = pii.train(docs)
    got = {r.doc_id: r for r in pii.find_spans(docs, field).collect()}
    for i, t in plain.items():
        want = []
        for kind in pii.KINDS:
            for m in re.finditer(pii.PATTERNS[kind], t):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
                if ok:
                    want.append((kind, m.start(), m.end()))
        assert [tuple(x) for x in got[i].base] == want
        assert {tuple(x) for x in got[i].base} <= {tuple(x) for x in got[i].spans}
    text = "call (499) 555-6503 now"
    assert [text[x.start : x.end] for x in got[48].spans if x.kind == "phone"] == ["(499) 555-6503"]
    assert pii.find_spans(empty, field).count() == 0 and pii.redacted(empty, field).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(docs, field).collect()}
    assert clean[42] == "mail [EMAIL] or [PHONE]" and clean[9] is None
    assert pii.find_spans(with_null_id(docs), pii.train(empty)).count() == len(plain) + 1


def test_pii_field_on_held_out_examples():
    field = pii.learn(pii.composed(seed=7))
    hit = extra = total = 0
    for text, gold in pii.composed(seed=99, count=200):
        found = {s for a, b in pii.regions(text) for s in field.best(*pii.Field.spans(text, a, b))}
        hit, extra, total = hit + len(found & set(gold)), extra + len(found - set(gold)), total + len(gold)
    assert hit / total > 0.85 and extra / max(1, hit + extra) < 0.15


def test_pii_field_on_held_out_corpus_texts(spark):
    """Numbers of the corpus in forms that the patterns miss, labelled by plain rules: +1 (663) 555-6869 without its
    country code, and addresses with @ spelled out. Texts that were learned from are left out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field, others = pii.train(docs.where("doc_id % 2 = 0")), docs.where("doc_id % 2 = 1")
    hit = total = extra = 0
    for r in others.where(F.col("text").rlike(r"[0-9@]")).collect():
        text = re.sub(r"\+\d{1,3} (?=\(\d{3}\) \d{3}-\d{4})", "", r.text or "")
        text = re.sub(r"([a-z]+)@([a-z]+)\.(com|org|net)\b", r"\1 (at) \2 (dot) \3", text)
        want = {("phone", *m.span()) for m in re.finditer(r"(?<![\d+])\(\d{3}\) \d{3}-\d{4}", text)} | {("email", *m.span()) for m in re.finditer(r"[a-z]+ \(at\) [a-z]+ \(dot\) [a-z]+", text)}
        base, found = map(set, pii.all_spans(text, field))
        want -= base
        hit, total, extra = hit + len(want & found), total + len(want), extra + len(found - base - want)
    print(hit, total, extra)
    assert total > 20 and hit / total > 0.9 and extra < 0.1 * total + 3


def test_pii_sums_over_all_segmentations():
    """Best segmentation, chances of spans and of steps, and the gradient, against a list of all segmentations."""
    text, rng = "call (12) 34 5.6 7", np.random.default_rng(0)
    cuts, spans = pii.Field.spans(text, 4, len(text))
    spans = spans[:14]
    starts = defaultdict(list)
    for x, (i, _, _) in enumerate(spans):
        starts[i].append(x)

    def listed(i):
        if i == len(cuts) - 1:
            return [()]
        return listed(i + 1) + [((x, k), *rest) for x in starts[i] for rest in listed(spans[x][1]) for k in range(4)]

    every = listed(0)
    assert len(every) > 100
    kinds = np.full(len(spans), -1)
    gold = max(every, key=len)
    for x, k in gold:
        kinds[x] = k
    index: dict = {}
    lattice = pii._Lattice([(len(cuts), spans, kinds)], index)
    weights, steps = rng.normal(size=(len(index), 4)), rng.normal(size=(5, 4))
    field = pii.Field(index, weights, steps)

    def value(seg, weights, steps):
        score, total, before = pii.Field(index, weights, steps).scores(spans), 0.0, 0
        for x, k in seg:
            total, before = total + score[x, k] + steps[before, k], k + 1
        return total

    values = np.array([value(x, weights, steps) for x in every])
    assert field.best(cuts, spans) == [(pii.KINDS[k], cuts[spans[x][0]], cuts[spans[x][1]]) for x, k in every[int(values.argmax())]]
    p = np.exp(values) / np.exp(values).sum()
    chance, taken = np.zeros((len(spans), 4)), np.zeros((5, 4))
    for seg, q in zip(every, p, strict=True):
        before = 0
        for x, k in seg:
            chance[x, k] += q
            taken[before, k] += q
            before = k + 1
    got, got_taken, whole = lattice.expected(lattice.scores(weights), steps)
    order = sorted(range(len(spans)), key=lambda x: (spans[x][1], spans[x][0]))
    assert np.allclose(got, chance[order]) and np.allclose(got_taken, taken) and np.isclose(whole[0], np.exp(values).sum())
    like = lambda w, t: value(gold, w, t) - np.log(sum(np.exp(value(x, w, t)) for x in every))
    by_weight, by_step = lattice.gradient(weights, steps)
    for f, k in ((0, 0), (1, 2), (3, 3)):
        move = np.zeros_like(weights)
        move[f, k] = 1e-4
        assert np.isclose((like(weights + move, steps) - like(weights - move, steps)) / 2e-4, by_weight[f, k], atol=1e-4)
    move = np.zeros_like(steps)
    move[0, 1] = 1e-4
    assert np.isclose((like(weights, steps + move) - like(weights, steps - move)) / 2e-4, by_step[0, 1], atol=1e-4)


def test_pii_samples_pieces_of_all_regions(spark):
    """A long text gives pieces of its end too, none over the bound, equal ones once; repeats and long texts are rows."""
    long = " ".join(f"word 12 word{i}" for i in range(3000)) + " end 4465758382889437"
    given = spark.createDataFrame([(1, long), (1, long), (None, "tel 555-123-4567"), (2, None), (3, "")], "doc_id long, text string")
    pieces = pii.sampled_pieces(given, sample=10**6)
    assert len(pieces) == len(set(pieces)) > 100 and max(map(len, pieces)) == pii.LONGEST and any("4465758382889437" in p for p in pieces)
    assert len(pii.sampled_pieces(given, sample=7)) == 7
    rows = pii.find_spans(given, pii._composed_field()).collect()
    assert len(rows) == 5 and len({str(r.spans) for r in rows if r.doc_id == 1}) == 1 and [len(r.base) for r in rows if r.doc_id == 1] == [1, 1]


def test_chat_round_trip(spark):
    r = random.Random(3)
    odd = ["\\", "<|", "<|end|>\n", "\\<|", "<", "|>", "<|assistant|>\n", "a", "\n", "é", "$1"]
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "x|>"]), None if r.random() < 0.1 else "".join(r.choice(odd) for _ in range(r.randint(0, 8))), "extra"))
    got = {x.conv_id: x for x in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))).collect()}
    for c in range(40):
        turns = [(role or "", text or "") for i, _, role, text, _ in sorted([x for x in rows if x[0] == c], key=lambda x: x[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), h("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), h(loss))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(chat.format_chats(none)).count() == 0
    one = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "hi")], "conv_id long, turn long, role string, text string")
    assert sorted(x.loss_chars for x in chat.chat_digests(chat.format_chats(one)).collect()) == [0, 2]


def test_chat_long_repeated_and_clashing(spark):
    """Turns that repeat a number, conversations of many turns, and columns named as working columns are."""
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, 1, "assistant", "x", 3), (1, 1, "assistant", "x", 4), (1, None, "system", "s", 5)]
    rows += [(2, i, ["user", "assistant"][i % 2], f"t{i}" * 20, i) for i in range(300)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t long").withColumn("example", F.lit(1)).withColumn("loss_start", F.lit("x"))
    made = chat.format_chats(given)
    assert made.columns == ["conv_id", "example", "formatted", "loss_start", "loss_end", "lone"]
    plain = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    order = {1: [("system", "s"), ("user", "a"), ("user", "b"), ("assistant", "x"), ("assistant", "x")], 2: [(r[2], r[3]) for r in rows if r[0] == 2]}
    got = made.collect()
    for c, turns in order.items():
        want = {i: plain(turns[: i + 1]) for i, (role, _) in enumerate(turns) if role == "assistant"}
        assert {x.example: x.formatted for x in got if x.conv_id == c} == want
        for x in got:
            if x.conv_id == c:
                assert x.formatted[x.loss_start : x.loss_end] == turns[x.example][1] and x.formatted[x.loss_end :] == "<|end|>\n"


def test_classifier(spark, sf, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(classifier.STATISTICS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    model = classifier.grow(x[:400], y[:400])
    assert ((model.score(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    for k in range(5):  # the flattened walk is the tree's
        node, s = np.zeros(1, int), model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[k, f[node]] > t[node])
            s += v[node - len(f)]
        assert abs(s - model.margin(x[k : k + 1])[0]) < 1e-9
    labels = spark.createDataFrame([(0, 1), (30, 0), (30, 0), (None, 1), (33, None)], "doc_id long, quality int")
    rows = classifier.score(with_null_id(docs), classifier.train(docs, labels)).collect()
    assert len(rows) == docs.count() + 1 and all(0 <= r.score <= 1 for r in rows)
    assert classifier.score(empty, classifier.train(empty, labels)).count() == 0
    got = classifier.op6_classifier(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_bpe(docs, empty, plain, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in bpe.encode_texts(docs, path("word_bpe_49k.json")).collect()}
    for i, x in plain.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i].decoded == t.decode(ids, skip_special_tokens=False) and rows[i].n_tokens == len(ids)
    assert bpe.token_text_digests(empty, path("word_bpe_49k.json")).count() == 0
    assert bpe.token_text_digests(with_null_id(docs), path("word_bpe_49k.json")).count() == len(plain) + 1
    alpha = ["a", "the", "'s", "'ll", "é", "ß", " ", "\n", "\xa0", "1", "23", "!", "<|endoftext|>", "<|startoftext|>", "漢字", "\x1c", "İ", "ΑΣ", "​", "😀", "ª", "ing", "KING", "aaaa", "ﬁ"]
    r, b = random.Random(3), bpe.load(path("word_bpe_49k.json"))
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for x, (n, ids, decoded) in zip(texts, b.encode(texts), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False)), x


def test_bpe_keeps_bounded_stores(path, monkeypatch):
    """Stores that fill up again and again, long words and texts without spaces change no result."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(bpe, "KEPT_NODES", 300)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 300)
    b, r = bpe.TrieBPE(path("word_bpe_49k.json")), random.Random(4)
    for _ in range(12):
        texts = [" ".join("".join(r.choice("abcdeé漢") for _ in range(r.choice([3, 8, 70, 3000]))) for _ in range(5)) for _ in range(20)]
        for x, (n, ids, decoded) in zip(texts, b.encode(texts), strict=True):
            want = t.encode(x, add_special_tokens=False).ids
            assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False))
        assert b.kept_bytes < 20_000 + 20 * 5 * 3000 and max(map(len, b.chunks)) <= bpe.LONG_CHUNK and len(b.node_last) < 300 + 20 * 5 * 64
    assert [len(x) for x in bpe._asked(["a" * (5 << 20), "b", None] + ["c"] * 600)] == [1, 500, 102]


def _removed_rows(rows, window):
    """Rows (id, text) → sorted (id, words, removed, kept): each row by its own text, against all rows of smaller ids."""
    first, words = {}, [(i, t.encode().split()) for i, t in rows]
    for i, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def _removed(texts, window):
    return {i: rest for i, *rest in map(tuple, _removed_rows(list(texts.items()), window)) for rest in [tuple(rest)]}


@pytest.mark.parametrize("window", [3, 13])
def test_substring(spark, docs, empty, plain, window, monkeypatch):
    monkeypatch.setattr(substring, "LEAVES", 4)
    got = substring.dedup_substrings(docs, window=window)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == _removed(plain, window)
    assert substring.dedup_substrings(empty).count() == 0
    assert substring.dedup_substrings(with_null_id(docs.unionByName(docs))).count() == 2 * len(plain) + 1


@pytest.mark.parametrize("limit", [substring.FREQUENT_BYTES, 600, 1])
def test_substring_repeated_ids_and_frequent_prefixes(spark, monkeypatch, limit):
    """Rows of one id are judged by their own texts, and prefixes of many continuations give the same by either way."""
    monkeypatch.setattr(substring, "FREQUENT_BYTES", limit)
    r = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    base = " ".join(r.choice(w) for _ in range(400))
    rows = [(1, base[:600]), (2, base[:600]), (2, " ".join(r.choice(w) for _ in range(30))), (1, base[:600])]
    for i in range(160):
        head = " ".join("all rights reserved " + " ".join(r.choice(w) for _ in range(4)) for _ in range(r.randint(1, 6)))
        rows.append((i % 70 + 3, head + (" " + base[r.randint(0, 500) :][: r.randint(50, 900)] if r.random() < 0.5 else "")))
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substring.dedup_substrings(given).collect()) == _removed_rows(rows, 13)


def test_substring_layout():
    text = "a  b\n\nc d\te\n f "
    assert substring.without_words(text, np.array([0, 0, 1, 1, 0, 0], bool)) == "a  b\n\n\te\n f "
    assert substring.without_words(text, np.array([1, 0, 0, 0, 0, 1], bool)) == "  b\n\nc d\te\n  "
    assert substring.without_words(text, np.ones(6, bool)) == " " and substring.without_words(text, np.zeros(6, bool)) == text


def test_substring_long_and_crowded(spark):
    r = random.Random(8)
    few = ["a", "b"]
    texts = {i: " ".join(r.choice(few) for _ in range(r.randint(0, 60))) for i in range(60)}
    texts[100] = " ".join(r.choice(WORDS) for _ in range(30000))
    texts[101] = "pre " + texts[100][1000:90000]
    small = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring.dedup_substrings(small).collect()}
    assert got == _removed(texts, 13)


def test_substring_pieces_of_long_texts():
    held = [x for part in substring._pieces([pd.DataFrame({"doc_id": [1, 2], "key": [0, 0], "text": ["w " * 10, " ".join(map(str, range(2_000_000)))]})], 13) for x in part]
    words, at = [str(x) for x in range(2_000_000)], 0
    for d, _, base, data in held[1:]:
        w = data.decode().split()
        assert d == 2 and words[base : base + len(w)] == w and base <= max(0, at - 12)
        at = base + len(w)
    assert at == len(words)


def test_spotsigs(docs, empty, plain):
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect()}
    ids = sorted(plain, reverse=True)
    sets = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    for k, i in enumerate(ids):
        t, n = plain[i], plain[ids[(k + 1) % len(ids)]]
        m = len(t) // 3
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), h(t[: len(t) - m] + n[:m]))
        a, b = sets(r.fingerprint), sets(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(1.0 if a == b else len(a & b) / max(1, len(a | b)))
        c = sets(got[ids[(k + 1) % len(ids)]].fingerprint)
        assert r.near_next == pytest.approx(1.0 if a == c else len(a & c) / max(1, len(a | c)))
    assert got[0].fingerprint == got[3].fingerprint and got[9].fingerprint == ""
    assert spotsigs.edited_fingerprints(empty).count() == 0
    assert spotsigs.edited_fingerprints(with_null_id(docs)).count() == len(plain)


def _chosen(spark, texts):
    """The words that a hash chooses to begin a signature."""
    import regex

    words = {x for t in texts for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x}
    rows = spark.createDataFrame([(x,) for x in sorted(words)], "w string")
    return {r.w for r in rows.where(F.pmod(F.hash(F.lit("#"), "w"), F.lit(spotsigs.EVERY)) == 0).collect()}


def _plain_signatures(text, chosen):
    """Chains of a text as tuples of words."""
    import regex

    if not text:
        return set()
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    if not w:
        return {("?", text)}
    common = set(spotsigs.ANCHORS)
    found = {("^", *(w + [""])[:2]), ("$", *([""] + w)[-2:])}
    for i, x in enumerate(w):
        after = [y for y in w[i + 1 :] if y not in common][:2]
        if x in common and len(after) == 2:
            found.add((x, *after))
        if x in chosen and i + 2 < len(w):
            found.add(("+", *w[i : i + 3]))
    return found


def test_spotsigs_signatures(spark, docs):
    """As many signatures as chains, and as many in common, for all pairs of texts."""
    rows = docs.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect()
    chosen = _chosen(spark, [r.text for r in rows])
    both = [(set(r.s), _plain_signatures(r.text, chosen)) for r in rows]
    for s, p in both:
        assert len(s) == len(p)
        for t, q in both:
            assert len(s & t) == len(p & q)


def test_spotsigs_small_edits_stay_small(spark):
    """Words added to a text, or taken from it, touch a few signatures each, in texts with and without common words."""
    r = random.Random(2)
    common = sorted(set(spotsigs.ANCHORS))
    texts = [[r.choice(common) if r.random() < share else f"v{r.randrange(3000)}" for _ in range(120)] for share in (0, 0.02, 0.05, 0.1, 0.4) for _ in range(12)]
    rows = []
    for i, w in enumerate(texts):
        e = list(w)
        for _ in range(2):
            e.insert(r.randrange(len(e)), f"n{r.randrange(3000)}")
        del e[r.randrange(len(e))]
        rows.append((i, " ".join(w), " ".join(e)))
    d = spark.createDataFrame(rows, "i int, a string, b string")
    got = d.select(spotsigs.signatures(F.col("a")).alias("x"), spotsigs.signatures(F.col("b")).alias("y")).collect()
    for g in got:
        x, y = set(g.x), set(g.y)
        assert len(x) >= 5
        assert len(x ^ y) <= 3 * 12  # an edit is within reach of at most a few chains on either side


def test_spotsigs_repeated_ids(spark):
    """One row for each row with an id, edited by its own length; the next document is the next id's text of least hash."""
    rows = [(1, "the cat sat on a mat " * 4), (1, "another text of the same id " * 3), (2, "the second text is of a kind"), (2, "the second text is of a kind"), (9, None), (None, "x y z")]
    got = spotsigs.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))).collect()
    key = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for _, t in rows[:3]}
    first = min((rows[0][1], rows[1][1]), key=key.get)
    after = {9: rows[2][1], 2: first, 1: ""}
    want = []
    for i, t in rows[:5]:
        t = t or ""
        m = len(t) // 3
        want.append((i, len(t), h(t[: len(t) - m] + after[i][:m])))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_spotsigs_groups(docs, plain):
    sig = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    pairs = {(r.a, r.b) for r in spotsigs.near_pairs(docs, 0.6).collect()}
    rep = {}
    for i in sorted(sig):
        rep.setdefault(sig[i], i)
    reps = [(i, s) for s, i in rep.items() if s]
    want = {(max(a, b), min(a, b)) for a, s in reps for b, t in reps if a < b and len(s & t) / len(s | t) >= 0.6}
    assert pairs == want
    groups = {r.doc_id: r.group_id for r in spotsigs.near_groups(docs, 0.6).collect()}
    assert len(groups) == len(plain) and groups[3] == 0


def test_queries_are_registered(spark, sf):
    from sparkloom.llm.queries import ORACLES, QUERIES

    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def test_spotsigs_without_anchors_read_whole_texts(spark):
    table = [f"t{i}" for i in range(56)]
    texts = [" | ".join(table), " | ".join(table[:2] + [f"u{i}" for i in range(54)]), "the of and " * 8, "and der la " * 8, "a b", "a c"]
    sigs = [set(r.s) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(spotsigs.signatures(F.col("text")).alias("s")).collect()]
    assert len(sigs[0]) > 5 and len(sigs[0] & sigs[1]) <= 2
    assert sigs[2] != sigs[3] and sigs[4] != sigs[5]
