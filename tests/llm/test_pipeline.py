import pathlib
import re
from collections import Counter, defaultdict

from kalkula.llm.common import cut_lineage
from tests.llm import test_mixing, test_packing, test_pii, test_quality, test_resemblance
from tests.llm.fixtures import ROWS, SCHEMA, write

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, path):
    """What each stage made of its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, path))
        out.append(docs)
    return out


def test_each_stage_against_brute_force(spark):
    raw, good, single, clean, mixed, packed = stages(spark, "/root/testdata/sf0.001")
    for df in (good, single, clean, mixed):
        assert df.columns == raw.columns
    rows = lambda df: [tuple(r) for r in df.select(*COLUMNS).collect()]
    raw, good, single, clean, mixed = map(rows, (raw, good, single, clean, mixed))
    for r in good:
        m = test_quality.brute(r[1])
        assert m[0] >= 20 and 100 * m[4] <= 30 * m[0]
    assert set(good) < set(raw) and len(good) > 0.6 * len(raw)
    assert sorted(r[0] for r in single) == test_resemblance.brute(good)  # five words, 0.8: not the fingerprints of op7's contract
    assert set(single) <= set(good)
    before = {r[0]: r for r in single}
    for r in clean:
        was = before[r[0]]
        assert (r[0], r[2], r[3]) == (was[0], was[2], was[3])
        if sum(test_pii.brute(was[1])[:4]) == 0:
            assert r == was or "term" in r[1] or len(r[1]) < len(was[1])
        else:
            assert r[1] != was[1] and r[4] == len(r[1])
        assert test_pii.brute(r[1])[0] == 0
    copies = Counter(mixed)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        sizes[r[3]] += n
        taken[r[3]] += n * copies[r]
    want = test_mixing.targets(sizes)
    largest = max(len(r[1].split()) for r in clean)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    got = sorted((tuple(r)[:5] for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert got == test_packing.brute(mixed)


def test_awkward_rows_and_empty_table(spark, tmp_path):
    import corpus_pipeline

    many = ROWS + [(100 + i, " ".join(f"w{i}x{j}" for j in range(30)), "en", None, 3, "x") for i in range(5)]
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", many)).count() > 0
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "b", [], SCHEMA)).count() == 0


def test_results_of_one_stage_outlive_another(spark, tmp_path):
    """Two results of a stage at a time, both unread; and a result whose tables go once it is written and handed on."""
    import corpus_pipeline
    from kalkula.llm.common import noted_tables

    first, second = (spark.read.parquet(write(spark, tmp_path / x) + "/documents.parquet") for x in "ab")
    a = corpus_pipeline.drop_near_duplicates(spark, first, "")
    b = corpus_pipeline.drop_near_duplicates(spark, second, "")
    assert a.count() == b.count() > 0
    a.write.parquet(f"{tmp_path}/a2")
    written = spark.read.parquet(f"{tmp_path}/a2")
    assert noted_tables(written) == noted_tables(a) != []
    c = corpus_pipeline.sanitise(spark, written, "")
    assert c.count() == written.count() == b.count()
    assert not any(pathlib.Path(p.removeprefix("file:")).exists() for p in noted_tables(a))
    assert all(pathlib.Path(p.removeprefix("file:")).exists() for p in noted_tables(b))
    direct = corpus_pipeline.sanitise(spark, b, "")  # not written in between: its tables stay
    assert set(noted_tables(b)) & set(noted_tables(direct))
    assert direct.count() == b.count()


def test_threads_keep_their_tables_apart(spark):
    import threading

    from kalkula.llm.common import recorded

    start, done, other = threading.Event(), threading.Event(), []

    def write_meanwhile():
        start.wait(60)
        with recorded() as paths:
            cut_lineage(spark.range(3))
        other.extend(paths)
        done.set()

    thread = threading.Thread(target=write_meanwhile)
    thread.start()
    with recorded() as mine:
        start.set()
        assert done.wait(60)
        cut_lineage(spark.range(4))
    thread.join()
    assert len(mine) == len(other) == 1 and mine != other
