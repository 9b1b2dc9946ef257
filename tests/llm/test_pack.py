import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from timberline.llm import pack
from timberline.llm.queries import tokenizer_path

TEXTS = [None, "", "a", "word " * 3000, "Ñandú für être <|endoftext|> x", "日本語 текст　​ ok", "a" * 5000, " " * 3000 + "z", "tab\tnew\nline", *(f"doc {i} " * (i % 90) for i in range(400))]


@pytest.mark.parametrize("bins", [2, 256])
def test_pieces_cover_each_document_and_sequences_have_no_gaps(spark, bins):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    got = pack.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path(), open_bins=bins, round_tokens=20_000).toPandas()
    exact = Tokenizer.from_file(tokenizer_path())
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        want = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        mine = got[got.doc_id == i].sort_values("piece")
        assert [x for ids in mine.ids for x in ids] == want
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
        assert all(mine.length[1:] == 1024) if len(mine) > 1 else True
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 1024
    if bins == 256:
        assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 1024 + 2


def test_checksum_is_of_the_ids(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    row = pack.pack(df, tokenizer_path()).first()
    assert pack.pack(df, tokenizer_path(), ids="crc32").first().ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())


def test_empty_table(spark):
    assert pack.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_full_bins_close_fullest_first():
    bins = pack.BestFit(10, 2)
    assert bins.place(4, ("a",)) == [] and bins.place(7, ("b",)) == []
    assert bins.place(8, ("c",)) == [(2, [("c", 0)])]
    assert bins.place(3, ("d",)) == [(1, [("b", 0), ("d", 7)])]
