import re

import duckdb

from coldkeep.llm.decontamination import contained, drop_contaminated
from coldkeep.llm.queries import QUERIES
from tests.conftest import SF

WORD = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    sets = [(i, shingles(t)) for i, t in items]
    out = set()
    for d, t in docs:
        own = shingles(t)
        out |= {(d, i, len(s & own), len(s)) for i, s in sets if s and 10 * len(s & own) >= 8 * len(s)}
    return out


def rows_of(df):
    return {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in df.collect()}


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = rows_of(QUERIES["op9_decontamination"](spark, SF))
    assert got == brute(docs, items) and got


def test_small(spark):
    item = " ".join(f"w{i}" for i in range(40))
    noise = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    items = [(1, item), (2, None), (3, ""), (4, "Short one"), (5, "a b c d e f"), (6, item)]
    docs = [
        (1, None), (2, ""), (3, "short ONE!"), (4, f"{noise(20000, 'x')} {item} {noise(3, 'y')}"), (5, f"q a, b. c d e f r {noise(500, 'z')}"),
        (6, " ".join(item.split()[:36])), (7, " ".join(item.split()[:32])), (8, f"{' '.join(item.split()[:20])} {noise(9, 'k')} {' '.join(item.split()[18:])}"),
        (9, noise(300, "n")),
    ]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert rows_of(contained(spark, d, b)) == want and {(4, 1), (3, 4), (5, 5), (8, 6)} <= {w[:2] for w in want}
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {w[0] for w in want}
    assert contained(spark, d, b.limit(0)).count() == 0 and drop_contaminated(d, b.limit(0)).count() == len(docs)
    assert contained(spark, d.limit(0), b).count() == 0
