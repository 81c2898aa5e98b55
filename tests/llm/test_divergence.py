import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from kalkula.llm import divergence
from kalkula.llm.divergence import OP11_SQL, audit, op11_single_pass_index, share
from tests.llm.fixtures import ROWS, SCHEMA, write

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    """The contract word by word. rows: (text, lang, source)."""
    docs = [(TERM.findall((text or "").translate(LOWER)), lang or "", source or "") for text, lang, source in rows]
    held = Counter((lang, w) for words, lang, _ in docs for w in set(words))
    count = defaultdict(Counter)
    for words, lang, source in docs:
        for w in words:
            if held[lang, w] >= least:
                count[lang, source][w] += 1
                count[lang][w] += 1

    def p(key, lang, w):
        n, v = sum(count[key].values()), len(count[lang])
        return 1 + 10**9 * (count[key][w] + 1) // (n + v)

    out = []
    groups = {(lang, source) for _, lang, source in docs}
    for lang, source in groups:
        values = {"pair": {o: 0 for m, o in groups if m == lang and o != source}, "term": {}}
        for w in count[lang]:
            mine = p((lang, source), lang, w)
            for o in values["pair"]:
                q = p((lang, o), lang, w)
                values["pair"][o] += (mine - q) ** 2 // q
            q = p(lang, lang, w)
            if count[lang, source][w] and mine > q:
                values["term"][w] = (mine - q) ** 2 // q
        for part, found in values.items():
            ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


MORE = [(i, text, lang, source, 1, "x") for i, (text, lang, source) in enumerate([("b a B a", "en", "a"), ("a b é É", "en", None), ("a é é ſ", "en", "c"), ("a'b_c1d", "en", "b"), ("c d c", "en", "c"), ("ΣΑΣ é d", "en", ""), ("eins", "de", "a"), (None, "de", "b"), (" 12 ", "fr", "z")])]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark, tmp_path):
    got = op11_single_pass_index(spark, write(spark, tmp_path, ROWS + MORE))
    assert rows_of(got) == brute([(r[1], r[2], r[3]) for r in ROWS + MORE])


def test_sql_says_the_same(spark, tmp_path):
    path = write(spark, tmp_path, ROWS + MORE)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(OP11_SQL).fetchall()) == rows_of(op11_single_pass_index(spark, path))


def test_many_small_blocks_and_chunks(spark, tmp_path, monkeypatch):
    """Blocks that spill all the time, chunks of two postings, merges at every chunk, sums handed on early."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    want = rows_of(audit(docs))
    for name, value in {"BLOCK_POSTINGS": 500, "CHUNK": 2, "ROWS_AT_ONCE": 3, "POSTINGS_WAITING": 1, "PAIRS_AT_ONCE": 50, "SUMS_HELD": 40, "TEXT_BYTES": 2000}.items():
        monkeypatch.setattr(divergence, name, value)
    small = divergence.merged_runs(divergence.spilled_runs(docs.repartition(5), "text", "lang", "source", 3), 3, 2)
    n = small.agg(F.count("*"), F.countDistinct("lang", "term"), F.countDistinct("term_id")).collect()[0]
    assert n[0] == n[1] == n[2]
    assert rows_of(audit(docs.repartition(5))) == want
    assert want == brute([tuple(r) for r in docs.select("text", "lang", "source").collect()])


def test_languages_that_start_with_one_another(spark, monkeypatch):
    """Null, `e`, `en` and `en-US` in one table: runs are in the order of their keys, so no term is merged in two parts."""
    langs, sources = [None, "e", "en", "en-US", "en\x00", "é"], [None, "a", "b"]
    rows = [(" ".join(f"{chr(97 + (i * j) % 26)}{chr(97 + j % 7)}" for j in range(i % 12)), langs[i % 6], sources[i // 6 % 3]) for i in range(120)]
    block = divergence.Block()
    block.add(pa.array([r[0] for r in rows]), [r[1] or "" for r in rows], [r[2] or "" for r in rows])
    keys = [t for batch in block.run(1) for r in batch.to_pylist() for t in r["terms"]]
    assert keys == sorted(keys)
    for name, value in {"BLOCK_POSTINGS": 100, "CHUNK": 2, "ROWS_AT_ONCE": 3, "POSTINGS_WAITING": 1, "TEXT_BYTES": 500}.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert rows_of(audit(docs)) == brute(rows)


def test_a_block_is_spilled_in_order():
    block = divergence.Block()
    block.add(pa.array(["b a a", "a c", "z"]), ["y", "x", "x"], ["s", "s", "t"])
    rows = [r for batch in block.run(1) for r in batch.to_pylist()]
    assert [t for r in rows for t in r["terms"]] == [b"x\xffa", b"x\xffc", b"x\xffz", b"y\xffa", b"y\xffb"]
    assert [n for r in rows for n in r["counts"]] == [1, 1, 1, 2, 1]


def test_empty_table_and_tables_without_terms(spark, tmp_path):
    assert op11_single_pass_index(spark, write(spark, f"{tmp_path}/none", [], SCHEMA)).count() == 0
    rows = [(1, "1 2", "en", "a", 1, "x"), (2, None, "en", "b", 1, "x")]
    got = op11_single_pass_index(spark, write(spark, f"{tmp_path}/bare", rows))
    assert rows_of(got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_text_and_shares_of_great_counts(spark, tmp_path):
    rows = [(i, "alpha beta " * n, "en", s, 1, "x") for i, (n, s) in enumerate([(900_000, "a"), (3, "b"), (1, "c")])]
    got = op11_single_pass_index(spark, write(spark, tmp_path, rows))
    assert rows_of(got) == brute([(r[1], r[2], r[3]) for r in rows])
    n, d = 8 * 10**15, 9 * 10**15
    df = spark.createDataFrame([(n, d)], "count long, of long")
    assert df.select(share("count", "of")).collect()[0][0] == 1 + 10**9 * (n + 1) // d


def test_extra_columns_of_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(write(spark, tmp_path, MORE) + "/documents.parquet")
    more = docs.withColumn("term", F.lit("x")).withColumn("p", F.lit(1)).withColumn("value", F.lit(2)).withColumn("key", F.lit(3)).withColumn("shard", F.lit(0))
    assert rows_of(audit(more)) == rows_of(audit(docs))
