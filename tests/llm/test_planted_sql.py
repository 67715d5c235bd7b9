"""Queries with SQL on planted tables: null and repeated ids, hot groups, ties and extra columns, against DuckDB."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabsight.llm.queries import QUERIES
from tabsight.llm.tokenfile import write_token_files


def against_sql(spark, tmp_path, query, table, data):
    pq.write_table(data, tmp_path / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    want = con.execute(QUERIES[query].sql).to_arrow_table()
    got = QUERIES[query].fn(spark, str(tmp_path))
    names = sorted(want.column_names)
    rows = Counter(tuple(r[c] for c in names) for r in got.collect())
    assert rows == Counter(tuple(r[c] for c in names) for r in want.to_pylist())
    return rows


def test_pages_without_an_id_own_no_payload(spark, tmp_path):
    big, lone, small = "x" * 200, "y" * 300, "z" * 50
    rows = [(None, big), (5, big), (7, big), (7, big), (5, big), (None, lone), (None, lone), (8, small), (9, small), (None, small),
            (10, None), (11, ""), (None, None)] + [(100 + k, big) for k in range(60)]
    data = pa.table({"page_id": pa.array([i for i, _ in rows], pa.int64()), "url": [f"http://a.example/{k}" for k in range(len(rows))],
                     "html": pa.array([h for _, h in rows], pa.string()), "first": [1] * len(rows), "digest": ["d"] * len(rows)})
    got = against_sql(spark, tmp_path, "op1_warc_segments", "pages", data)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    seen = Counter((r[0], r[3], r[4]) for r in (tuple(dict(zip(sorted(names), row))[n] for n in names) for row in got.elements()))
    assert seen[(None, "revisit", 5)] == 1 and seen[(None, "response", None)] == 4 and seen[(5, "response", None)] == 2


def test_pages_of_an_empty_table(spark, tmp_path):
    data = pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())})
    assert not against_sql(spark, tmp_path, "op1_warc_segments", "pages", data)


@pytest.mark.parametrize("repeated", [False, True])
def test_lines_of_rows_that_share_an_id_or_have_none(spark, tmp_path, repeated):
    shared = "a line that many documents share"
    rows = [(3, f"{shared}\nown line of three"), (None, f"{shared}\nfirst without an id"), (None, f"{shared}\nsecond without an id"),
            (None, f"{shared}\nsecond without an id"), (4, None), (6, ""), (2, f"first of two\n{shared.upper()}")]
    rows += [(50 + k, f"{shared}\nonly in {k} of them") for k in range(40)]
    if repeated:
        rows += [(1, f"{shared}\nanother common line"), (1, "another common line\nand more of it"), (9, "another common line"),
                 (1, "another common line\nand more of it")] + [(20, f"the hot id has line {k % 7} again") for k in range(40)]
    data = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()),
                     "tie": [0] * len(rows), "kept_text": ["k"] * len(rows)})
    got = against_sql(spark, tmp_path, "op5_line_runs", "documents", data)
    assert sum(got.values()) == len(rows)


def test_token_files_choose_a_width_that_holds_every_id(spark, docs, tmp_path):
    from tabsight.llm.queries import word_vocabulary
    from tabsight.llm.tokenfile import read_token_index
    few = docs.limit(5)
    with pytest.raises(ValueError):
        write_token_files(spark, few, word_vocabulary(), end_id=70_000, wide=False)
    crc = lambda **kw: {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in
                        read_token_index(spark, write_token_files(spark, few, word_vocabulary(), **kw)).collect()}
    assert crc(end_id=70_000) == crc(end_id=70_000, wide=True) != crc(end_id=70_000 - (1 << 16))


def test_capital_letters_that_compose_with_marks(docs):
    from tokenizers import Tokenizer
    from tabsight.llm.queries import word_vocabulary
    from tabsight.llm.wordtok import WordTokenizer
    texts = ["Y̊ H̱ T̈ W̊ J̌ ẙ", "PLAIN Words"]
    lib = Tokenizer.from_file(word_vocabulary())
    flat, offs = WordTokenizer(word_vocabulary()).encode(pa.array(texts, pa.large_string()))
    assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
