"""Token files, packing and archives: exact round trips."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import packing, queries, token_output, warc
from tidewater.llm.common import materialize, new_path
from tidewater.llm.files import new_file, old_file
from tidewater.llm.tokens import WordTokenizer

ODD = ["", None, " a", "a ", "  a  b ", "a\n\n b  c \n d", "x\x1c y \x85 z", "it's 'll  don't ", "é ́x", "é  é é ñ\n", "foo  <|endoftext|> a<|endoftext|>", "a\t \tb", "  ", "日本 語 。 a　b", "Σ ΑΣ. σς", "1234 56  7", "İstanbul İ", "w" * 9000, "word, " * 3000, "a_b-c.d"]


def library_ids(path, text):
    return WordTokenizer(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_tokenizer_equals_the_library(name):
    path = queries.tokenizer_path(name)
    t = WordTokenizer(path, cache_size=50)
    rng = random.Random(4)
    mixed = ["".join(rng.choice(["the", "Ünder", " ", "  ", "\n", ".", ",", "'s", "9", "é", " ", "!?", "ß", "\t"]) for _ in range(40)) for _ in range(200)]
    for texts in (ODD, mixed, mixed):
        ids, offsets = t.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in t.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == want


def test_sequence_file_gives_random_access(spark):
    folder = new_path(spark, "t")
    ids = np.arange(1000, dtype=np.uint32)
    with new_file(folder, ".arrow") as (sink, name):
        w = token_output.SequenceWriter(sink, 16, 4, 49_408)
        for part in np.array_split(ids, 7):
            w.add(part)
        w.close()
    with old_file(folder, name) as source:
        r = token_output.SequenceReader(source)
        for i in (0, 3, 4, 62):
            values, mask = r.sequence(i)
            n = min(16, 1000 - 16 * i)
            assert values[:n].tolist() == ids[16 * i : 16 * i + n].tolist() and mask.to_pylist() == [True] * n + [False] * (16 - n)
            assert not values.flags.owndata
        assert r.ids(5, 900).tolist() == ids[5:905].tolist() and r.ids(7, 0).tolist() == []
        assert r.crc32(5, 900) == zlib.crc32(ids[5:905].astype("<u4").tobytes())
        with pytest.raises(ValueError, match="masked"):
            r.ids(990, 12)  # into the padding
        assert r.file.schema.field("input_ids").type == pa.list_(pa.uint16(), 16)


def test_token_output_round_trip(spark):
    ids = [7, 3, None, 11, *range(100, 116)]
    docs = spark.createDataFrame(list(zip(ids, ODD, ["x"] * 20, strict=True)), "doc_id long, text string, first string").repartition(4)
    path = queries.tokenizer_path("word_bpe_49k.json")
    found = sorted(token_output.encode_and_read(spark, docs, path, length=32).collect(), key=lambda r: r.start)
    order = sorted(range(20), key=lambda i: (ids[i] is not None, ids[i] or 0))
    start = 0
    for r, i in zip(found, order, strict=True):
        want = np.array([*library_ids(path, ODD[i]), 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (ids[i], start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_output.encode_and_read(spark, docs.limit(0), path).count() == 0


def test_token_output_deals_one_id_to_several_files(spark):
    """All rows have no id, and a third of them one text: they still are dealt out, and each row comes back once."""
    texts = ["same text"] * 300 + [f"text number {i}" for i in range(600)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("start", F.lit("clash"))
    path = queries.tokenizer_path("word_bpe_49k.json")
    folder = new_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little text would be one task
    try:
        manifest = materialize(token_output.write_tokens(docs, folder, path), "manifest")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 1 and sum(sizes) == 900 and max(sizes) < 600
    found = sorted(token_output.read_documents(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == [0, *itertools.accumulate(r.n_tokens for r in found)][:-1]
    library = WordTokenizer(path).tokenizer
    want = [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for t in texts]
    assert sorted(r.ids_crc32 for r in found) == sorted(want)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 25))}
    slots = packing.plan_slots(histogram, capacity)
    ranks, content = {}, {}
    for length, a, b, first, offset in slots:
        ranks.setdefault(length, []).extend(range(a, b))
        for k in range(b - a):
            content.setdefault(first + k, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(content) == best_fit_decreasing([k for k, n in histogram.items() for _ in range(n)], capacity)


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(5, "again", 2), (None, "no id", 3)], "doc_id long, text string, length int").repartition(3)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    found = packing.pack(spark, docs, path, capacity=64).collect()
    for i, t in enumerate(ODD):
        ids = np.array([*library_ids(path, t), 2], dtype="<u4")
        mine = sorted((r for r in found if r.doc_id == i and not (i == 5 and r.length == 2)), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 64)))
        assert all(r.length == 64 for r in mine[1:]) and [r.start for r in mine] == [0, *itertools.accumulate(r.length for r in mine)][:-1] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        assert [o for o, _ in sorted(items)] == [0, *itertools.accumulate(n for _, n in sorted(items))][:-1] and sum(n for _, n in items) <= 64
    assert len(sequences) == best_fit_decreasing([r.length for r in found], 64)
    assert packing.pack(spark, docs.limit(0), path).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_warc_round_trip(spark, version):
    long = "<p>" + "payload " * 30
    pages = [(5, "http://a.org/ x", long), (2, "https://b.org/", long), (9, None, long), (7, "http://c.org", "short"), (8, "http://d.org", "short"), (1, "http://e.org", None), (3, "dns:x", "é\r\n\r\n" * 60), (4, "http://f.org\nx", ""), (None, "http://g.org", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumnRenamed("url", "url").selectExpr("*", "1 AS file", "2 AS digest")
    found = {r.page_id: r for r in warc.pages_to_warc(spark, df, version).collect()}
    assert len(found) == len(pages)
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if p is not None and (h or "").encode() == payload]
        first = min(same) if len(payload) >= 100 and page_id != min(same) else None
        r = found[page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if first is not None else "response", first)
        assert r.date == "2024-01-01T00:00:00Z" and r.record_id.startswith("<urn:uuid:")
    assert warc.pages_to_warc(spark, df.limit(0)).count() == 0


def test_arc_header_lines_of_both_versions():
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    v1 = b"http://a b/ 1.2.3.4 19970101000000 text/html %d\n" % len(body) + body + b"\ntrailing"
    r = warc.parse_arc_record(v1, 1)
    assert (r.url, r.ip, r.date, r.mime, r.split()[1]) == ("http://a b/", "1.2.3.4", "19970101000000", "text/html", b"hello")
    v2 = b"http://a/ 1.2.3.4 19970101 text/html 200 abc - 17 f.arc %d\n" % len(body) + body
    assert warc.parse_arc_record(v2, 2).split()[1] == b"hello"
    assert warc.warc_date("19970101") == "1997-01-01T00:00:00Z" and warc.warc_date("-") == "1970-01-01T00:00:00Z" and warc.warc_date("1997") == "1997-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        warc.parse_arc_record(b"http://a/ 1.2.3.4 text/html x\nbody", 1)


def test_conversion_of_other_records():
    record = warc.ArcRecord("dns:a.org", "8.8.8.8", "19990203040506", "text/dns", b"answer")
    fields, block = warc.parse_warc_record(warc.convert_record(record, "f", 0, None))
    assert (fields["warc-type"], fields["warc-date"], fields["content-type"], fields["warc-ip-address"], block) == ("resource", "1999-02-03T04:05:06Z", "text/dns", "8.8.8.8", b"answer")
