import hashlib
import math
import re

import pytest

from kalkula.llm import pii as P
from tests.llm.fixtures import ROWS, SCHEMA, write

MORE = [
    (60, "é mail a.b@c.de, x@y.z@w.v, @no.pe, a@b, é@é.fr, q@a.b-c.d. AB@CD.EF", "en", "a", 1, "x"),
    (61, "1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 1.2.3 99999999999.1.1.1", "en", "a", 1, "x"),
    (62, "4111 1111 1111 1111 4111-1111-1111-1112 4785380592391139 1 2 3 30569309025904 4111  1111", "en", "a", 1, "x"),
    (63, "+1 (499) 555-6503, +49 30 1234567 + 1 2 +123 +1234567890123456 +12-34-56-78-90)", "en", "a", 1, "x"),
    (64, "a@b.c" * 3, "en", "a", 1, "x"),
    (65, "a@b.c" * 3, "en", "a", 1, "x"),
]


def luhn(d):
    t = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in t) % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    out.sort()
    names = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in out)
    return (*(sum(x[1] == k for x in out) for k in range(4)), hashlib.sha256(names.encode()).hexdigest())


def test_base_spans(spark, tmp_path):
    rows = ROWS + MORE
    got = sorted((tuple(r)[:6] for r in P.op10_information_content(spark, write(spark, tmp_path, rows)).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_base_spans_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:6] for r in P.op10_information_content(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs}


def corpus():
    """The word `zanzibar` goes with one address, `common` with everything."""
    rows = [(i, f"common words number{i} here write to ann@home.org about zanzibar and topic{chr(97 + i)} today", "en", "a", 1, "x") for i in range(8)]
    rows += [(100 + i, f"common words number here write text {'abcdefghij'[i % 10]}{'klmno'[i % 5]}xyz about other things and bob{i}@work.org today", "en", "a", 1, "x") for i in range(40)]
    rows += [(200 + i, "common copies of one and the same text about flamingo and eve@home.org today", "en", "a", 1, "x") for i in range(30)]
    return [*rows, (300, "only zanzibar is named", "en", "a", 1, "x"), (301, None, "en", "a", None, "x")]


def test_disclosure_is_as_defined(spark):
    rows = corpus()
    got = {(r["term"], r["entity"]): r["disclosure"] for r in P.disclosing_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    n, n_e, n_t = len(rows), 8, 9
    assert got == {("zanzibar", "email:ann@home.org"): pytest.approx(math.log2((8 / n_e) / (n_t / n)) / math.log2(n / n_e))}


def test_sanitise(spark):
    docs = spark.createDataFrame(corpus() + MORE, SCHEMA)
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[0]["text"] == "common words number0 here write to <email> about  and topica today" and by[0]["n_chars"] == len(by[0]["text"])
    assert by[300]["text"] == "only  is named" and by[301]["text"] is None
    assert by[200]["text"].endswith("about flamingo and <email> today")
    for r in by.values():
        assert brute(r["text"])[:4] == (0, 0, 0, 0) or r["doc_id"] in (60, 62, 63), r


def test_hash_is_the_same_in_spark_and_tasks(spark):
    import xxhash
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("größe",), ("a" * 50,)], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(P.SLOTS)).alias("s")).collect()
    assert all(x["s"] == xxhash.xxh64_intdigest(x["term"].encode(), 42) % P.SLOTS for x in r)


def test_empty_table(spark, tmp_path):
    assert P.op10_information_content(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0


def test_names_beside_an_address_mentioned_once(spark):
    """One to three contexts are enough, and names of three letters count."""
    rows = [(i, f"common words here write text about other things and person{i}@work.org today", "en", "a", 1, "x") for i in range(60)]
    rows += [(100, "common words here write to Kowalczyk at rare@home.org today", "en", "a", 1, "x"), (101, "common words here ask Kim or two@home.org today", "en", "a", 1, "x"), (102, "other things about Kim and two@home.org here", "en", "a", 1, "x")]
    by = {r["doc_id"]: r["text"] for r in P.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "Kowalczyk" not in by[100] and "Kim" not in by[101] and "Kim" not in by[102]
    assert by[0] == "common words here write text about other things and <email> today"


def brute_spans(texts):
    """All spans of each text by the definitions, word by word."""
    texts = [t or "" for t in texts]
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    words = lambda t: [(m.start(), m.end(), lower(m[0])) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", t)]
    base = []
    for t in texts:
        names = lambda k, pattern, good=lambda m: True: [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if good(m)]  # noqa: B023, E731
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        base.append(sorted(
            names(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
            + names(1, r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(x) <= 255 for x in m[0].split(".")))
            + names(2, r"[0-9](?:[ -]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)))
            + names(3, r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)
        ))
    contexts = set()
    for t, spans in zip(texts, base, strict=True):
        free = [w for w in words("".join(" " if any(a <= i < b for a, _, b in spans) else c for i, c in enumerate(t)))]
        for a, kind, b in spans:
            before, after = [w for w in free if w[0] < a][-P.WINDOW :], [w for w in free if w[0] >= a][: P.WINDOW]
            contexts.add((f"{kind}:{lower(t[a:b])}", tuple(w[2] for w in before + after)))
    n, held = len(texts), [{w[2] for w in words(t)} for t in texts]
    terms = set()
    for entity in {e for e, _ in contexts}:
        own = [c for e, c in contexts if e == entity]
        for term in {w for c in own for w in c if len(w) >= P.MIN_LETTERS}:
            n_et, n_t = sum(term in c for c in own), sum(term in h for h in held)
            share, rate, content = n_et / len(own), min(1.0, max(n_t, n_et) / n), math.log2(n / len(own))
            kl = share * math.log(share / min(rate, share)) + ((1 - share) * math.log((1 - share) / (1 - min(rate, share))) if share < 1 else 0)
            if content > 0 and math.log2(share / (max(n_t, n_et) / n)) / content >= P.THRESHOLD and len(own) * kl >= -math.log(P.CHANCE):
                terms.add(term)
    out = []
    for t, spans in zip(texts, base, strict=True):
        more = [(a, 4, b) for a, b, w in words(t) if w in terms and not any(x < b and a < y for x, _, y in spans)]
        out.append(",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans + more)))
    return out


def test_whole_query_by_brute_force(spark, tmp_path):
    names = [(400, "écrire à Kowalczyk, rare@home.org today", "fr", "a", 1, "x"), (401, "KOWALCZYK once more\nsee +1 (499) 555-6503 or Zürich", "en", "a", 1, "x"), (402, "ask Kim or two@home.org here", "en", "a", 1, "x")]
    rows = [*corpus(), *MORE, *[r for r in ROWS if r[0] != 5], *names, names[0]]
    got = sorted(((r["doc_id"], r["spans"]) for r in P.op10_information_content(spark, write(spark, tmp_path, rows)).collect()), key=str)
    expected = sorted(((r[0], s) for r, s in zip(rows, brute_spans([r[1] for r in rows]), strict=True)), key=str)
    assert got == expected and sum("term:" in s for _, s in got) > 3


def test_names_of_extra_columns(spark):
    from pyspark.sql import functions as F

    extra = ["pii_blob", "PII_May", "pii_spans", "pii_text", "pii_base", "term_spans", "blob", "span", "term", "hash", "mentions", "row"]
    docs = spark.createDataFrame(corpus() + MORE, SCHEMA).select("*", *(F.lit(f"my {c}").alias(c) for c in extra))
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count() and all(r[c] == f"my {c}" for r in rows for c in extra)
    plain = {(r["doc_id"], r["text"]) for r in P.sanitise(spark.createDataFrame(corpus() + MORE, SCHEMA)).collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} == plain
