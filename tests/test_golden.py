"""Known cases of the text and path functions."""

import re

import pytest
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions import entities as ent
from docspark.functions import labels, names, paths, registration, text
from docspark.functions.spans import annotate_spans
from docspark.operators import search


def value(spark, expression, **columns):
    row = spark.createDataFrame(
        [tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return row.select(expression.alias("v")).first().v


@pytest.mark.parametrize("path,profile,confidence", [
    ("ES150929.pdf", "work_order", 0.92),
    ("WO-ES001229.pdf", "work_order", 1.0),
    ("AviationArchive/TS-INP/Check_A/Job_Cards/ES001778.pdf", "work_order", 0.92),
    ("nothing/here.txt", "unknown", 0.0),
])
def test_profile_from_path(spark, path, profile, confidence):
    found = value(spark, paths.profile_from_path("p"), p=path)
    assert (found.profile, found.confidence) == (profile, confidence)


@pytest.mark.parametrize("reference,number", [
    ("ES00001778", "1778"), ("ES001392", "1392"), ("00203601", "203601"),
    ("ES 000", "0"), ("", "")])
def test_normalise_es(spark, reference, number):
    assert value(spark, ent.normalise_es("r"), r=reference) == number


@pytest.mark.parametrize("body,refs", [
    ("linked wp     ES001234     MSN2158", ["ES001234"]),
    ("LINKED WP : ES 001234", ["ES001234"]),
    ("wp linked ES152410", ["ES152410"]),
    ("linked wp ES001234 / ES001235, ES001234", ["ES001234", "ES001235"]),
    ("nothing", [])])
def test_linked_wp(spark, body, refs):
    assert value(spark, ent.linked_wp_refs("t"), t=body) == refs


@pytest.mark.parametrize("raw,full", [
    ("NQ", "TS-INQ"), ("INQ", "TS-INQ"), ("OENQ", "TS-INQ"), ("ts-inp", "TS-INP"),
    (" inp ", "TS-INP"), ("TS-INA", None), ("X", None)])
def test_normalise_registration(spark, raw, full):
    assert value(spark, registration.normalise_registration("r"), r=raw) == full


@pytest.mark.parametrize("body,name,expected", [
    ("A/C TS-INC then TS-INQ", "x.pdf", "TS-INQ"),
    ("A/C TS-INU and TS-INC", "x.pdf", "TS-INC"),
    ("TS-INQ", "TS-INB_1.pdf", "TS-INB"),
    ("a/c \n inq", "x.pdf", "TS-INQ"),
    ("créent", "x.pdf", None)])
def test_extract_registration(spark, body, name, expected):
    found = value(spark, registration.extract_registration("t", "n"), t=body, n=name)
    assert found == expected


def test_repeated_prefix(spark):
    twice = ("TS-INP_Check C_ES001392_Defect Report_"
             "TS-INP_Check C_ES001392_Defect Report_63.pdf")
    once = "TS-INP_Check C_ES001392_Defect Report_63.pdf"
    assert value(spark, names.collapse_repeated_prefix("f"), f=twice) == once
    assert value(spark, names.collapse_repeated_prefix("f"), f=once) == once


@pytest.mark.parametrize("aircraft,kind,category,entities,expected", [
    ("TS-INQ", "WORK_ORDER", "Check A", {"es_reference": "ES154313"},
     "TS-INQ_Check_A_Work_Order_ES154313.pdf"),
    ("TS-INQ", "AD", "AD", {"es_reference": "ES152173"}, "TS-INQ_AD_ES152173.pdf"),
    ("TS-INP", "DB_CHART", "Structural Repair", {"item_number": "R001"},
     "TS-INP_Structural_Repair_DB_Chart_R001.pdf"),
    ("TS-INQ", "JOBCARD", "Check A", {"item_number": "0015"},
     "TS-INQ_Check_A_Jobcard_0015.pdf"),
    ("TS-INQ", "SB", "SB", {"sb_ad_reference": "SB22-1360"},
     "TS-INQ_SB_SB22-1360.pdf")])
def test_suggested_filename(spark, aircraft, kind, category, entities, expected):
    fields = {n: F.lit(entities.get(n)).cast("string") for n in (
        "es_reference", "sb_ad_reference", "work_order_number", "item_number",
        "serial_number", "ata_chapter")}
    made = names.suggested_filename(
        F.lit(aircraft), F.lit(kind), F.lit(category), fields, F.lit("old.pdf"))
    assert value(spark, made, x="") == expected


def test_profile_entities(spark):
    card = ("AIRCRAFT REGISTRATION: TS-INP    MSN: 2158\nFSN: ES001778-A  CHECK: Check A\n"
            "ATA CHAPTER: 32-40-00  P/N: 114760-001-01  S/N: JF4892\n"
            "FLIGHT HOURS: 14523.5  FLIGHT CYCLES: 8921\nDATE: 15/03/2026\n")
    found = value(
        spark, ent.profile_entities("t", "p"), t=card, p="job_card")
    assert found["AIRCRAFT_REG"] == ["TS-INP"]
    assert found["ATA_CHAPTER"] == ["32-40-00"]
    assert found["FSN"] == ["ES001778-A"]
    assert found["FLIGHT_HOURS"] == ["14523.5"]
    assert "WORK_ORDER" not in found


@pytest.mark.parametrize("kind,letter", [
    ("CHECK_A", "A"), ("C Check", "C"), ("Check D", "D"), ("4D", "D"),
    ("Line", None)])
def test_check_letter(spark, kind, letter):
    assert value(spark, labels.check_letter("k"), k=kind) == letter


@pytest.mark.parametrize("category,kind", [
    ("Check C", "Check C"), ("CHECK A", "Check A"), ("Specs", "Check A")])
def test_inferred_check_type(spark, category, kind):
    assert value(spark, labels.inferred_check_type("c"), c=category) == kind


def test_query_variants(spark):
    made = search.query_variants("ES 1778")
    assert made[:3] == ["ES 1778", "1778", "ES1778"]
    assert "ES00001778" in made and "ES 00001778" in made
    assert made == value(spark, search.query_variants_column(F.col("q")), q="ES 1778")
    assert search.query_variants("landing gear") == ["landing gear"]


def test_snippet(spark):
    body = "a" * 150 + " ES001042 " + "b" * 150
    found = value(spark, text.snippet("t", "ES001042"), t=body)
    assert found.startswith("…") and found.endswith("…") and "ES001042" in found
    assert value(spark, text.snippet("t", "zzz"), t="short") == "short..."


def test_wildcards_stay_wildcards(spark):
    docs = spark.createDataFrame(
        [(1, "ES0012", "x"), (2, "none", "y")],
        "id long, filename string, ocr_text string")
    for c in search.SEARCH_COLUMNS:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    hits = search.substring_search(docs, "es_0%2").collect()
    assert [r.id for r in hits] == [1]


def test_windowed_texts(spark):
    made = text.embedding_text(
        F.col("t"), F.lit("f.pdf"), {}, "p", body_chars=5, total_chars=12)
    assert value(spark, made, t="abcdefgh") == "p filename f"
    whole = text.embedding_text(F.col("t"), F.lit("f"), {})
    assert value(spark, whole, t="abcdefgh" * 1000).endswith("abcdefgh" * 1000)


def test_spans_do_not_overlap(spark):
    body = "TS-INQ ES001778 ATA 32-40 P/N: AB123-4 DATE 2024-01-02"
    spans = value(spark, annotate_spans(["Acme Air"])("t"), t=body)
    ends = [0] + [s.end for s in spans]
    assert all(s.start >= e for s, e in zip(spans, ends))
    assert {s.label for s in spans} >= {"AIRCRAFT_REG", "ES_REF", "ATA_CHAPTER"}


def find_spans(text, names=()):
    """Plain loop: an earlier label or pattern keeps its place."""
    patterns = [(lb, p) for lb, many in fv.SPAN_PATTERNS.items() for p in many]
    if names:
        patterns.append(("AIRLINE", rf"\b({'|'.join(map(re.escape, names))})\b"))
    taken, spans = set(), []
    for label, pattern in patterns:
        for match in re.finditer(pattern, text, re.I):
            place = range(*match.span(1))
            if taken.isdisjoint(place):
                taken |= set(place)
                spans.append((*match.span(1), label))
    return sorted(spans)


def test_spans_match_plain_loop(spark, tables):
    hard = spark.createDataFrame([
        (-1, "éTS-INA TS-INB ats-inc ES001042 es 001043 ATA 21-30 21-30-11 P/N AB-123 Part No: XY99-1 "
             "SB é-abcd 5 AOÛT 2024 12 mars 2023 \U0001F600 2024-01-02 AD 2024-01-02 by Fly & Co. air"),
        (-2, None), (-3, "")], "id long, ocr_text string")
    rows = tables.text("id", "ocr_text").unionByName(hard)
    for names in ((), ("Acme Air", "Fly & Co")):
        for limit in (None, 60):
            found = rows.select("ocr_text", annotate_spans(names, limit)("ocr_text").alias("s"))
            assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
            for row in found.collect():
                want = find_spans(row.ocr_text or "", names)
                assert [tuple(s) for s in row.s] == [
                    w for w in want if limit is None or w[1] <= limit]


def test_given_order(spark, tables):
    found = search.in_given_order(tables.documents("id", "doc_type"), [42, 7, 99, 3])
    assert [(r.id, r.rank) for r in found.collect()] == [(42, 1), (7, 2), (99, 3), (3, 4)]


def test_prefix_scans(spark):
    import itertools

    from docspark.functions.basics import prefix_scan, prefix_sums

    for n in (0, 1, 7, 8, 9, 64, 65, 1000):
        xs = [(i * 37) % 11 - 3 for i in range(n)]
        holes = [x if i % 3 == 1 else None for i, x in enumerate(xs)]
        frame = spark.createDataFrame([(xs, holes)], "x array<int>, h array<int>")
        row = frame.select(prefix_sums(F.col("x")).alias("s"), prefix_scan(F.col("h"), F.greatest).alias("m")).first()
        assert row["s"] == list(itertools.accumulate(xs))
        best, want = None, []
        for h in holes:
            best = h if best is None else best if h is None else max(best, h)
            want.append(best)
        assert row["m"] == want


def test_spans_of_very_many_matches(spark):
    import time

    body = " ".join(f"ES{i % 10 ** 6:06d} TS-IN{chr(65 + i % 26)} P/N AB{i:05d}" for i in range(70_000))
    frame = spark.createDataFrame([(body,)], "t string").select(F.explode(annotate_spans()("t")).alias("s"))
    start = time.perf_counter()
    got = [tuple(r["s"]) for r in frame.collect()]
    assert time.perf_counter() - start < 60
    small = " ".join(body.split(" ")[:40])
    assert got[:len(find_spans(small))] == find_spans(small) and len(got) == 210_000
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
