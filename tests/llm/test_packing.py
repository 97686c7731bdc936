import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarryline.llm import packing
from quarryline.llm.bpe import ByteBpe
from quarryline.llm.common import chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "  x\n\n y ", "it's John's 'tis 's", "\n\na", "a\xa0b", "²x ½", "é è — “q”", "<|endoftext|> hi", "日本 語", "a\t\tb  ", " 12ab!?  ...\n  ", "x" * 5000, "ÀÉ 12Ωx"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    bpe = ByteBpe(packing.read_vocabulary())
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*ODD, None])})
    got = [ids[a:b].tolist() for _, data, at in chunks(iter([batch]), limit=50) for ids, first in [bpe.encode(data, at)] for a, b in zip(first, first[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in ODD] + [[]]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pieces(spark, library, capacity):
    texts = [*ODD, None, *[f"word{i} " * (i % 40) for i in range(300)], "same", "same"]
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in enumerate(texts)], "doc_id long, text string, offset string, sequence_id int").repartition(3)
    rows = packing.pack(docs, packing.read_vocabulary(), capacity, keep_ids=True).toPandas()
    for doc, own in rows.sort_values("start").groupby("doc_id"):
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        assert np.concatenate(own.ids.tolist()).tolist() == ids
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == own.ids_crc32.tolist()
    assert rows.doc_id.nunique() == len(texts)
    used = rows.sort_values("offset").groupby("sequence_id").length.agg(["sum", list])
    assert used["sum"].max() <= capacity
    for sequence, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    padding = sum(capacity - n for n in used["sum"] if n & (n - 1))
    assert padding < 0.07 * used["sum"].sum()


def test_null_and_large_ids(spark):
    docs = spark.createDataFrame([(None, "no id"), (2**53 + 1, "large id"), (None, "x" * 5000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, packing.read_vocabulary(), 16).collect()
    assert {r["doc_id"] for r in rows} == {None, 2**53 + 1}
    per_document = {(r["doc_id"], r["doc_tokens"]): 0 for r in rows}
    for r in rows:
        per_document[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert len(per_document) == 3 and all(n == tokens for (_, tokens), n in per_document.items())


def test_classes_fill_with_their_number_of_documents():
    """Sequences of class k hold k documents from its lengths before anything fills their room; padding is bounded and few documents are cut."""
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1, 1400, 3000), rng.geometric(0.004, 3000), [1024, 2048, 1, 1025]])
    rng.shuffle(lengths)
    packer, rows = packing.Packer(1024, 0), []
    for part in np.array_split(lengths, 7):
        at = np.concatenate([[0], np.cumsum(part)])
        rows += packer.add(list(range(len(rows), len(rows) + len(part))), np.arange(at[-1]), at)
    full = len(rows)
    rows += packer.finish()
    sequences = {}
    for i, (doc, start, ids, n, sequence, offset) in enumerate(rows):
        sequences.setdefault(sequence, []).append((offset, len(ids), i, start, n))
    padding = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, *_ in own] == np.concatenate([[0], np.cumsum([x[1] for x in own])])[:-1].tolist()
        used = sum(x[1] for x in own)
        padding += 1024 - used if used & (used - 1) else 0
        first = own[0]
        if first[2] < full and first[1] < 1024:
            k = 1024 // first[1]
            assert all(1024 // (k + 1) < x[1] <= 1024 // k and x[3] + x[1] == x[4] for x in own[:k])
    assert sum(len(r[2]) for r in rows) == lengths.sum() and padding < 2048
    needed = (-(-lengths // 1024)).sum()
    assert len(rows) < 1.5 * needed


def test_pipeline_of_odd_rows(spark):
    """Null and very long texts, repeated rows, columns with the names of the result."""
    names = [x.split(" ")[0] for x in packing.SCHEMA.split(", ") if not x.startswith("doc_id")]
    texts = [None, "", "word " * 300_000, "same", "same"]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    rows = packing.pack(df, packing.read_vocabulary()).collect()
    total = {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in range(5)}
    assert total[0] == total[1] == 1 and total[2] > 300_000 and total[3] == total[4] == 2
    assert all(r["doc_tokens"] == total[r["doc_id"]] for r in rows)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.read_vocabulary()).count() == 0


def test_cached_pieces_are_bytes():
    """Pieces that are kept between chunks take 4 bytes an id."""
    from quarryline.llm import bpe, packing

    own, text = bpe.ByteBpe(packing.read_vocabulary()), "some words and more unusualwordsthatarecut 123"
    data = text.encode()
    ids, _ = own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert ids.tolist() == own.encode_text(text).tolist()
    assert own.cache and sum(len(x) for x in own.cache.values() if isinstance(x, bytes)) == 4 * len(ids)
