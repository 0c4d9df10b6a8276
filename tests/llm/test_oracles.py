"""The queries that SQL can express, against it: over the given tables, and over tables of awkward rows."""

import os
import random
import zlib

import duckdb
import pandas as pd
import pytest
from graphnom.llm import queries

TABLES = ("documents", "conversations")


def compared(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
    rows = [sorted(repr([plain(v) for v in r]) for r in df[columns].itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]
    return got


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Copies and near copies with repeated shingles, secrets that many hold, variants, conversations with every fault."""
    rnd = random.Random(5)
    pool = [f"w{k}" for k in range(4000)]
    base = rnd.choices(pool, k=250)
    docs = [(None, None, None), (0, "", "a"), (1, " \t\n", "b"), (2, "one two three", None), (3, "one two three", "c"), (3, "one two three", "c")]
    for k in range(10, 60):
        edit = list(base) + ["again and again and"] * (20 if k % 3 == 0 else 0)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 30])):
            edit[rnd.randrange(250)] = f"e{rnd.random()}"
        docs.append((k, " ".join(edit), f"s{k % 4}"))
    token = "Ab3" * 10
    for k in range(100, 130):
        held = [f"password={token}x{k}", f'API_key : "example{k % 2}"', "AKIA" + "Q" * 16 + " é", "AKIAQQ", "d" * 24, token, f"own{k}X" * 6, "x" * 30, "secret=abc"]
        rnd.shuffle(held)
        docs.append((k, "ü😀 " + " ; ".join(held) + "\n", f"o{k % 7}" if k % 9 else None))
    for k in range(200, 260):
        docs.append((k, " ".join(rnd.choice(["Straße", "STRASSE", "Garçon", "garcon", "garcons", "naïveté", "naivete", "lettre", *["Letter"] * 30, *["letters"] * 4]) for _ in range(60)), "v"))
    docs.append((300, "long " * 60_000 + "a" * 1_000, "v"))
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rnd.choice([1, 2, 4, 9])):
            text = rnd.choice(["Hi.", "Hi.", "So it is", "What? ", "", " \t\n", None, "\x1f", "done!\r\n", "ä" * 5 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn * 3, None, 2]), rnd.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "Assistant"]), text))
    rows += rows[:30]
    rows.append((next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "This row is dropped."))
    out = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_given_tables(spark, name):
    compared(spark, "/root/testdata/sf0.001", name)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_awkward_tables(spark, folder, name):
    got = compared(spark, folder, name)
    if name.startswith("op1_"):
        sizes = got.groupby("class_id").size()
        assert sizes.max() > 10 and len(sizes) > 5
    if name.startswith("op2_"):
        assert got.n_example.max() > 1 and got.spans.str.contains("token:").any()
    if name.startswith("op11_"):
        assert (got.form.notna()).any()
