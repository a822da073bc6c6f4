from __future__ import annotations

import datetime as dt
import io
import json
import re
import tracemalloc
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import vocabulary as V
from tracelake.operators import briefs as B
from tracelake.operators import chunking as C
from tracelake.operators import evaluate as E
from tracelake.operators import ledger as L
from tracelake.operators import reconcile as R
from tracelake.operators import relational as Q
from tracelake.operators import review as W
from tracelake.operators import rules as U
from tracelake.operators import search as S2
from tracelake.sources import corpus as CORPUS
from tracelake.sources import files as S
from tracelake.sources import messages as M
from tracelake.sources import services as SERVICES
from tracelake.sources.paged import RecordedPages, full_pass
from tracelake.streaming import sync as Z


def block(text, at=0):
    return (text, at, at + len(text), None, None)


def test_packing_edges(spark):
    def texts(blocks, target, overlap=0.0):
        rows = spark.createDataFrame([(1, blocks)], f"id int, blocks {C.BLOCKS}")
        return [r["text"].split("\n\n") for r in C.chunks(rows, "id", target, overlap).orderBy("ordinal").collect()]

    assert texts([], 10) == []
    assert texts([block("a" * 5), block("b" * 5)], 10) == [["a" * 5, "b" * 5]]
    assert texts([block("a" * 5), block("b" * 6)], 10) == [["a" * 5], ["b" * 6]]
    assert texts([block("aaa"), block("bb"), block("c" * 8)], 10, 0.2) == [["aaa", "bb"], ["bb", "c" * 8]]
    # what is carried and the next block do not fit together: the block is taken all the same
    assert texts([block("a" * 8), block("bb"), block("c" * 9)], 10, 0.2) == [["a" * 8, "bb"], ["bb", "c" * 9]]
    rows = spark.createDataFrame([(1, [block("one two  three", 7)]), (2, None), (3, [block("x" * 9 + "   " + "é" * 8)])], f"id int, blocks {C.BLOCKS}")
    cut = C.chunks(rows, "id", 8, 0.0).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["text"], r["char_start"], r["char_end"]) for r in cut] == [(1, "one two", 7, 14), (1, "three", 16, 21), (3, "x" * 8, 0, 8), (3, "x  ", 8, 11), (3, "é" * 8, 12, 20)]
    with pytest.raises(ValueError):
        C.chunks(rows, "id", 0)


def test_ties_stay_in_latest(spark):
    t = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("b", 3, "error"), ("b", 3, "error")], "k string, at int, s string")
    assert Q.latest_failures(t, ["k"], "at", F.col("s") == "error").count() == 2


def test_relational_nulls(spark):
    t = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, v string")
    assert Q.repeated_keys(t, ["k"]).count() == 0
    assert Q.orphans(t, t.where("k = 9"), {"k": "k"}).count() == 1
    assert Q.broken_checks(t, {"k": F.col("k") > 1}, ["v"]).collect()[0]["check"] == "k"
    kept = Q.without_scope({"t": t}, "k", 1)["t"]
    assert kept.count() == 2


def test_illegal_transitions(spark):
    rows = [("decision", "create", None, "active"), ("decision", "create", None, "open"), ("risk", "complete", "open", "completed"), ("risk", "resolve", "open", "resolved"), ("commitment", "update", "canceled", "open"), ("commitment", "reopen", "canceled", "open"), ("milestone", "correct", "completed", "open")]
    t = spark.createDataFrame(rows, "kind string, transition string, from_status string, to_status string")
    assert {tuple(r) for r in L.illegal(t).collect()} == {rows[1], rows[2], rows[4]}


CASES = {
    "no candidate": ({"item_id": None, "match_tier": None, "score": None}, "CREATE"),
    "update without target": ({"kind": "update", "item_id": None, "match_tier": None, "score": None}, "CONFLICT"),
    "repeat from here": ({"subject_token_similarity": 0.9, "has_evidence": True}, "NO_OP"),
    "second source": ({"subject_token_similarity": 0.9}, "ADD_EVIDENCE"),
    "changed date": ({"statement": "It moved to June", "date_value": dt.date(2024, 6, 1)}, "UPDATE"),
    "date without cue": ({"date_value": dt.date(2024, 6, 1)}, "CONFLICT"),
    "changed owner": ({"statement": "Handed off to Bo", "person_id": "bo"}, "UPDATE"),
    "owner without cue": ({"person_id": "bo"}, "CONFLICT"),
    "completed": ({"statement": "The report was sent"}, "COMPLETE"),
    "to be completed": ({"statement": "Ana will finish what was sent"}, "CONFLICT"),
    "cancelled": ({"statement": "That was called off"}, "CANCEL"),
    "delayed": ({"statement": "It is delayed", "subject_token_similarity": 0.8}, "ADD_EVIDENCE"),
    "superseded": ({"statement": "B replaces A"}, "SUPERSEDE"),
    "risk that blocks": ({"kind": "blocker", "item_kind": "risk", "statement": "Work is blocked"}, "SUPERSEDE"),
    "close candidates": ({"margin": 0.1}, "CONFLICT"),
    "reversal": ({"item_status": "completed", "statement": "The report was sent"}, "CONFLICT"),
    "weak": ({"match_tier": "uncertain", "score": 0.4}, "CREATE"),
}


def test_decision_list(spark):
    base = {"kind": "commitment", "statement": "Ana owns the report", "explicitness": "explicit", "owner_outcome": "resolved", "owner_text": "Ana", "person_id": "ana", "date_value": None, "date_text": None, "item_id": "i", "item_kind": "commitment", "item_status": "open", "item_owner": "ana", "item_due": dt.date(2024, 5, 1), "score": 0.9, "margin": None, "match_tier": "strong", "subject_token_similarity": 0.5, "corrected_field_disagreement": 0.0, "has_evidence": None}
    schema = "name string, kind string, statement string, explicitness string, owner_outcome string, owner_text string, person_id string, date_value date, date_text string, item_id string, item_kind string, item_status string, item_owner string, item_due date, score double, margin double, match_tier string, subject_token_similarity double, corrected_field_disagreement double, has_evidence boolean"
    rows = spark.createDataFrame([(n, *(base | change).values()) for n, (change, _) in CASES.items()], schema)
    got = {r["name"]: r for r in R.confidence(R.classified(rows)).collect()}
    assert {n: r["action"] for n, r in got.items()} == {n: a for n, (_, a) in CASES.items()}
    assert got["completed"]["confidence_band"] == "high" and got["close candidates"]["match_band"] == "low"
    assert got["reversal"]["escalations"] == ["reversal_of_ended_item"] and got["risk that blocks"]["target_id"] == "i"


def test_reconciled_end_to_end(spark):
    statements = spark.createDataFrame([("s1", "p", "c1", "commitment", "Budget report", "Budget report was sent", None, "unknown", None, None, None, "explicit"), ("s2", "q", "c1", "commitment", "Budget report", "Budget report was sent", None, "unknown", None, None, None, "explicit")], "statement_id string, scope string, content_id string, kind string, subject string, statement string, owner_text string, owner_outcome string, person_id string, date_value date, date_text string, explicitness string")
    items = spark.createDataFrame([("i1", "p", "commitment", "Budget report", "", None, None, "open", dt.date(2024, 1, 1), False)], "item_id string, scope string, kind string, title string, description string, owner_id string, due date, status string, updated_at date, user_corrected boolean")
    linked = spark.createDataFrame([("i1", "c0")], "item_id string, content_id string")
    got = {r["statement_id"]: r["action"] for r in R.reconciled(statements, items, linked, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {"s1": "COMPLETE", "s2": "CREATE"}
    assert [r["statement_id"] for r in R.reconciled(statements, items, linked, F.lit("2024-02-01").cast("date"), spark.createDataFrame([("s1",), ("s1",)], "statement_id string")).collect()] == ["s2"]


def test_participants(spark):
    people = spark.createDataFrame([("a", "Ann@x.example", "Ann Ames"), ("b", None, "Bo"), ("c", None, "Bo C")], "person_id string, primary_email string, display_name string")
    aliases = spark.createDataFrame([("b", "name", "bo"), ("c", "name", "bo"), ("c", "name", "cee")], "person_id string, alias_type string, normalized_value string")
    lines = [(1, "Someone <ann@x.example>"), (2, "ANN@x.example "), (3, "Cee <new@x.example>"), (4, "Bo"), (5, "  "), (6, "Dee <d@x.example>"), (7, "d@x.example")]
    got = {r["line_id"]: (r["outcome"], r["person_id"], r["display_name"]) for r in R.participants(spark.createDataFrame(lines, "line_id int, line string"), people, aliases).collect()}
    assert got == {1: ("resolved", "a", "Ann Ames"), 2: ("resolved", "a", "Ann Ames"), 3: ("resolved", "c", "Bo C"), 4: ("ambiguous", None, "Bo"), 6: ("unknown", None, "Dee"), 7: ("unknown", None, "d@x.example")}


def test_candidates_by_phrase(spark):
    long = "unrelated " + " ".join(f"word{k}x" for k in range(60))
    said = [("s1", "p", "risk", "Vendor contract", "may slip badly"), ("s2", "p", "update", "Vendor contract", "may slip badly"), ("s3", "p", "risk", "Outage", "")]
    held = f"{long} The Vendor Contract, may slip badly! {long}"
    have = [("i01", "p", "risk", "Zebra", held), ("i02", "q", "risk", "Zebra", held), ("i03", "p", "decision", "Zebra", held), ("i04", "p", "risk", "Vendor contract", "may slip badly"),
            ("i05", "p", "risk", "Yak", f"{long} outage {long}")] + [(f"j{k:02d}", "p", "risk", "Zebra", f"{held} {'more ' * (k + 1)}") for k in range(12)]
    statements = R.prepared(spark.createDataFrame([(*r, False) for r in said], "statement_id string, scope string, kind string, subject string, statement string, refers boolean"), "subject", "statement")
    items = R.prepared(spark.createDataFrame([(*r, dt.date(2024, 1, 1)) for r in have], "item_id string, scope string, kind string, title string, description string, updated_at date"), "title", "description")
    got = {(r["statement_id"], r["item_id"]): r["tiers"] for r in R.candidates(statements, items).collect()}
    by_search = sorted(i for (s, i), tiers in got.items() if s == "s1" and tiers == ["search"])
    assert by_search == ["i01"] + [f"j{k:02d}" for k in range(8)]  # ten at most, i03 among them but of another kind
    assert got["s3", "i05"] == ["search"] and ("s1", "i02") not in got  # the phrase does not stand in one column of i04
    assert "search" not in got["s1", "i04"] and got["s2", "i04"] == ["exact"] and sum(s == "s2" for s, _ in got) == 1


def test_phrases(spark):
    rows = [(1, "A a, A b a-a."), (2, "é E"), (3, ""), (4, None), (5, "the of the"), (6, "Of the of the"), (7, "often there")]
    t = spark.createDataFrame(rows, "id int, text string")
    for phrase in ("a a", "e", "of the", "the of the", "", "!!", "b a a"):
        words = lambda x: re.findall(r"[a-z0-9]+", (x or "").lower().replace("é", "e"))
        w = words(phrase)
        want = {i: n for i, x in rows if (n := sum(words(x)[k : k + len(w)] == w for k in range(len(words(x)))) if w else 0)}
        assert {r["id"]: r["hits"] for r in S2.search(t, "id", ["text"], phrase).collect()} == want
        assert {r["id"]: r["hits"] for r in S2.phrase_hits(S2.postings(t, "id", "text"), "id", phrase).collect()} == want
    two = t.select("id", "text", F.lit("b c").alias("more"))
    assert {r["id"]: r["hits"] for r in S2.search(two, "id", ["text", "more"], "b").collect()} == {i: 2 if i == 1 else 1 for i, _ in rows}


def test_postings_hold_few_rows_at_a_time():
    words = [" ".join(f"w{(k * 7 + j) % 2500}" for j in range(3000)) for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(words)], names=["id", "tokens"])
    tracemalloc.start()
    rows = most = 0
    for out in S2._places(iter([batch]), ["token", "id", "positions", "length"]):
        rows, most = rows + out.num_rows, max(most, out.num_rows)
        assert set(out["length"].to_pylist()) == {3000}
        i, t, p = out["id"][0].as_py(), out["token"][0].as_py(), out["positions"][0].as_py()
        assert p == [k for k, w in enumerate(words[i].split()) if w == t]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400 * 2500 and most < S2.POSTINGS_ROWS + 2500 and peak < 32e6  # over 100 MB if all texts' are held


def test_rules_exclude_overrides(spark):
    e = spark.createDataFrame([("1", "Apollo sync", None), ("2", "Apollo private", "x"), ("3", "lunch", "with bo")], "id string, title string, description string")
    rules = {"project_name_terms": ["apollo"], "exclude_terms": ["private"], "include_terms": ["BO"]}
    got = {r["id"]: r["m"] for r in e.select("id", U.event_match(F.col("id"), F.col("title"), F.col("description"), F.array().cast("array<string>"), rules).alias("m")).collect()}
    assert got["1"]["tier"] == "project_name_term" and got["3"]["tier"] == "include_rule"
    assert not got["2"]["matched"] and got["2"]["reason"].startswith("excluded despite")
    assert U.configured({"include_regex": "("}, ("a",), ("include_regex",)) is False
    b = e.limit(1).select(U.boundary(F.lit('{"project_name_terms":[" a ",""],"client_domain":"@X.example"}')).alias("b")).first()["b"]
    assert b["project_name_terms"] == ["a"] and b["client_domain"] == "x.example"


VTT = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<v Ann>Hello\n\n00:00:02.000 --> 00:00:03.000\n<v Ann>there\n\n00:00:03.000 --> 00:00:04.000\nwho\n\n00:00:04.000 --> 00:00:05.000\nis it\n"


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>point</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


PDF = b"%PDF-1.4\n1 0 obj<</Length 70>>\nstream\nBT (This page has quite enough \\(plain\\) text on it) Tj ET\nendstream\nendobj"


def test_files(spark):
    rows = [("a.vtt", VTT.encode()), ("b.md", b"\xef\xbb\xbf# Head\n\nbody one\n \nbody two"), ("c.txt", "caf\xe9\n\n\nend".encode("cp1252")), ("d.pdf", b"plain"), ("e.vtt", b"WEBVTT\n\nbad --> cue"), ("f.docx", _docx()), ("g.pdf", PDF), ("h.txt", b" \n ")]
    files = spark.createDataFrame(rows, "path string, content binary")
    kinds = {r["path"]: r["k"] for r in files.select("path", S.file_kind(F.col("path"), F.col("content")).alias("k")).collect()}
    assert kinds == {"a.vtt": "vtt", "b.md": "markdown", "c.txt": "txt", "d.pdf": "unsupported", "e.vtt": "vtt", "f.docx": "docx", "g.pdf": "pdf", "h.txt": "txt"}
    got = {r["path"]: r for r in S.parsed_text(files).collect()}
    assert [(b["text"], b["section_path"], b["char_start"]) for b in got["a.vtt"]["blocks"]] == [("Ann: Hello there", "turn 1 (Ann)", 0), ("who is it", "turn 2", 18)]
    assert [(b["text"], b["section_path"], b["location_label"]) for b in got["b.md"]["blocks"]] == [("# Head", "heading: Head", "line 1"), ("body one", "under: Head", "line 3"), ("body two", "under: Head", "line 5")]
    assert [b["text"] for b in got["c.txt"]["blocks"]] == ["café", "end"]
    assert got["e.vtt"]["status"] == "failed" and got["h.txt"]["status"] == "empty" and got["d.pdf"]["status"] == "unsupported"
    binary = {r["path"]: r for r in S.parsed_binary(files.withColumn("kind", S.file_kind(F.col("path"), F.col("content")))).collect()}
    assert [(b["text"], b["location_label"]) for b in binary["f.docx"]["blocks"]] == [("Top", "paragraph 1"), ("point", "list item 2"), ("cell", "table 1 row 1 column 1")]
    assert binary["g.pdf"]["status"] == "parsed" and "(plain)" in binary["g.pdf"]["text"]


def test_pdf_pages():
    one, two = b"BT (Second page in the file, first one \\050in the tree\\051) Tj ET", zlib.compress(b"BT [(Hello ) -250 <776F726C64>] TJ (and caf\\351) ' ET")
    pdf = b"%PDF-1.5\n4 0 obj<</Length 9>>\nstream\n" + one + b"\nendstream\nendobj\n5 0 obj<</Filter /FlateDecode>>\nstream\n" + two + b"\nendstream\nendobj\n"
    tree = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R 6 0 R]>>"), (3, b"<</Type /Page /Contents 5 0 R>>"), (6, b"<</Type/Pages/Kids[7 0 R 2 0 R]>>"), (7, b"<</Type/Page/Contents [4 0 R]>>")]
    want = ["Hello world\nand café", "Second page in the file, first one (in the tree)"]
    plain = pdf + b"".join(b"%d 0 obj%s\nendobj\n" % x for x in tree)
    status, blocks = S.read_pdf(plain)
    assert status == "parsed" and [(b["text"], b["location_label"]) for b in blocks] == [(w, f"page {k}") for k, w in enumerate(want, 1)]
    head, body, at = [], b"", 0
    for number, content in tree:
        head.append(b"%d %d" % (number, at))
        body, at = body + content + b" ", at + len(content) + 1
    first = b" ".join(head) + b" "
    packed = pdf + b"9 0 obj<</Type /ObjStm /N 5 /First %d /Filter /FlateDecode>>\nstream\n" % len(first) + zlib.compress(first + body) + b"\nendstream\nendobj"
    assert [b["text"] for b in S.read_pdf(packed)[1]] == want
    assert S.read_pdf(pdf)[0] == "parsed" and len(S.read_pdf(pdf)[1]) == 2 and S.read_pdf(b"%PDF")[0] == "ocr_required"


def test_messages(spark):
    leaves = "array<struct<mime:string,filename:string,data:string>>"
    rows = spark.createDataFrame([(1, [("text/plain", None, "aGk"), ("text/plain", "x.txt", "eA"), ("text/html", None, "eA")]), (2, [("text/html", "", "PHA-eTwvcD4")]), (3, [])], f"id int, p {leaves}")
    assert {r["id"]: r["b"] for r in rows.select("id", M.body_text(F.col("p")).alias("b")).collect()} == {1: "hi", 2: "y", 3: None}


def test_evidence_containment(spark):
    t = spark.createDataFrame([(1, "a b c d e f g h"), (2, "xa b c d e f gx"), (3, "a b")], "id int, text string")
    n = spark.createDataFrame([(10, "b c d e f g"), (11, "a b c d e f g"), (12, "b"), (13, "zz")], "n int, needle string")
    got = {tuple(r) for r in E.containment(t, n, "id", "n").collect()}
    assert got == {(i, k) for i, x in ((1, "a b c d e f g h"), (2, "xa b c d e f gx"), (3, "a b")) for k, y in ((10, "b c d e f g"), (11, "a b c d e f g"), (12, "b"), (13, "zz")) if y in x}


def test_verdict(spark):
    good = {m: b - 0.001 if way == "<" else b for m, (way, b) in E.THRESHOLDS.items()}

    def say(values, by_project=()):
        frame = spark.createDataFrame(list(values.items()), "metric string, value double")
        each = spark.createDataFrame(list(by_project), "project string, metric string, value double")
        return E.verdict(E.threshold_checks(frame, each)).first()

    assert say(good)["verdict"] == "GO" and say(good)["passed"] == 14
    assert say({m: v for m, v in good.items() if m != "acceptance_rate"})["verdict"] == "ITERATE"
    assert say(good | {"cross_project_leakage": 1.0})["verdict"] == "STOP"
    assert say(good | {"beats_baseline": 0.0})["verdict"] == "STOP"
    assert say(good, [("a", "materially_misleading_rate", 0.049), ("b", "materially_misleading_rate", None)])["verdict"] == "GO"
    assert say(good, [("a", "materially_misleading_rate", 0.0), ("b", "materially_misleading_rate", 0.05)])["verdict"] == "STOP"
    assert say(good, [("a", "item_recall", 0.74)])["verdict"] == "ITERATE" and say(good, [("a", "item_recall", 0.75)])["verdict"] == "GO"
    assert set(V.TERMINAL) < set(V.STATUSES)


def test_report(spark):
    by = spark.createDataFrame([("b", "item_recall", 1, 2, 0.5), ("a", "item_recall", 0, 0, None)], "project string, metric string, numerator long, denominator long, value double")
    whole = spark.createDataFrame([("item_recall", 1, 2, 0.5), ("item_precision", 0, 0, None)], "metric string, numerator long, denominator long, value double")
    checks = E.threshold_checks(whole.select("metric", "value"))
    row = E.report(by, whole, checks).first()
    said = json.loads(row["json"])
    assert [p["project"] for p in said["per_project"]] == ["a", "b"] and said["verdict"] == "ITERATE" and len(said["threshold_checks"]) == 14
    assert "- item_recall: 50.0% (1/2)" in row["markdown"] and "- item_precision: n/a" in row["markdown"] and "- item_recall: fail" in row["markdown"]


def test_claims(spark):
    facts = spark.createDataFrame([("f1", "s", True), ("f2", "s", False), ("f3", "t", True)], "fact_id string, section string, has_evidence boolean")
    rows = [("none", "s", "fact", []), ("null", "s", "fact", None), ("good and unknown", "s", "fact", ["x", "f1"]), ("unknown", "s", "inference", ["x"]), ("other section", "s", "fact", ["f3"]), ("unproved", "s", "fact", ["f2"]), ("both", "s", "fact", ["f2", "f1"]),
            ("suggested", "s", "suggestion", ["x"]), ("plain", "u", "fact", ["f2"])]
    claims = spark.createDataFrame(rows, "claim_id string, section string, type string, fact_ids array<string>")
    got = {r["claim_id"]: (r["validation"], r["cited"]) for r in B.checked_claims(claims, facts.union(spark.createDataFrame([("f2", "u", False)], facts.schema)), ["u"]).collect()}
    assert got == {"none": ("invalid_reference", []), "null": ("invalid_reference", []), "good and unknown": ("valid", ["f1"]), "unknown": ("invalid_reference", ["x"]), "other section": ("invalid_reference", ["f3"]), "unproved": ("unsupported", ["f2"]),
                   "both": ("valid", ["f2", "f1"]), "suggested": ("valid", []), "plain": ("valid", ["f2"])}


def test_cutoffs_of_meetings_at_one_time(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("p", 1, day(2), None), ("p", 2, day(5), None), ("p", 3, day(5), None), ("p", 4, day(7), day(3)), ("p", 5, None, None), ("q", 6, day(9), None)]
    meetings = spark.createDataFrame(rows, "scope string, meeting_id int, at timestamp_ntz, override timestamp_ntz")
    created = spark.createDataFrame([("p", day(1)), ("q", day(1))], "scope string, created_at timestamp_ntz")
    assert {r["meeting_id"]: r["cutoff"] for r in B.cutoffs(meetings, created).collect()} == {1: day(1), 2: day(2), 3: day(2), 4: day(3), 5: day(1), 6: day(1)}


def test_claim_sentences_and_redaction(spark):
    rows = [("T", "o", "d", "open", None, None), ("T", None, None, None, None, None), ("T", "o", None, "done", "complete", "was open"), ("T", None, None, "done", "complete", None)]
    t = spark.createDataFrame(rows, "title string, owner string, due string, status string, transition string, previous string")
    said = [r[0] for r in t.select(T.claim_sentence(*(F.col(c) for c in t.columns))).collect()]
    assert said == ["T — status: open — owner: o — due: d.", "T.", "T — complete (now done); was open; owner o.", "T — complete (now done)."]
    nested = spark.createDataFrame([((1, "s3", [("n", {"My_API_KEY": "k", "x": "y"})]),)], "v struct<id:int,clientSecret:string,list:array<struct<name:string,more:map<string,string>>>>")
    out = nested.select(T.redacted(F.col("v"), nested.schema["v"].dataType).alias("v")).first()["v"].asDict(True)
    assert out == {"id": 1, "clientSecret": "[REDACTED]", "list": [{"name": "n", "more": {"My_API_KEY": "[REDACTED]", "x": "y"}}]}


def test_html(spark):
    rows = ["<p>a</p><p>b<br/>c<br>d</p>", "x<script>if (a < b) {}</script><style>p{}</style>y<!-- <p>no</p> -->", "<ul><li>1</li><li>2 &amp; 3</li></ul>", "a<p/>b<a href='x>y'>c</a> &lt;b&gt;", "<P>one  \t two</P>\n\n\n\nthree", "5 < 6", None, ""]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "h string").select(T.html_to_text("h")).collect()]
    assert got == ["a\n\nb\nc\nd", "xy", "1\n\n2 & 3", "abc <b>", "one two\n\nthree", "5 < 6", None, ""]


def test_quotes_name_the_owner(spark):
    seen = spark.createDataFrame([(1, "Ana  Bo", None), (2, "bo an", None), (3, "", None)], "observation_id int, owner_text string, date_value string")
    spans = spark.createDataFrame([(k, n, "c", a, b, q) for k in (1, 2, 3) for n, a, b, q in ((1, 7, 9, "Bo"), (0, 3, 6, "Ana"))], "observation_id int, ordinal int, chunk_id string, start int, end int, quote string")
    chunks = spark.createDataFrame([("c", "so Ana Bo")], "chunk_id string, text string")
    assert {r["observation_id"]: r["fault"] for r in W.validated(seen, spans, chunks).collect()} == {1: None, 2: "unsupported_owner", 3: None}


def test_corpus_round_trip(spark, tmp_path):
    manifest = {"schema_version": "1", "key": "p", "name": "P", "artifacts": [{"artifact_id": "a", "kind": "mail", "title": "t", "occurred_at": "2024-01-01T00:00:00Z", "filename": "a.txt", "material": True}, {"artifact_id": "b", "kind": "mail", "title": "t", "occurred_at": "yesterday", "filename": "b.txt", "material": True}], "checkpoints": []}
    step = lambda i, kind, words: {"transition_id": i, "type": kind, "mentions": [{"artifact_id": "a", "statement": words, "observed_owner": None}], "owner": None, "due_date": None, "status": "open", "supersedes_item_id": None, "materiality": "material"}
    truth = {"schema_version": "1", "project_key": "p", "items": [{"item_id": "i", "kind": "risk", "canonical_title": "T", "aliases": [], "transitions": [step("t1", "update_status", "was said"), step("t2", "update_status", "was not")]}]}
    for name, content in (("manifest", manifest), ("ground_truth", truth)):
        (tmp_path / "c" / "p").mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / "p" / f"{name}.json").write_text(json.dumps(content))
    manifests, truths = CORPUS.read(spark, str(tmp_path / "c"))
    CORPUS.write(manifests, str(tmp_path / "out"))
    assert spark.read.schema(CORPUS.MANIFEST).json(str(tmp_path / "out")).collect() == manifests.collect()
    texts = spark.createDataFrame([("a", "this was said here")], "artifact_id string, text string")
    assert {(r["what"], r["id"]) for r in CORPUS.faults(manifests, truths, texts).collect()} == {("time", "b"), ("first_transition", "i"), ("mention", "t2")}


def test_events_and_meetings_as_text(spark):
    none = F.lit(None).cast("string")
    people = F.array(F.lit("Ann"), F.lit("Bo"))
    turns = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(w).cast("string").alias("speaker"), F.lit(t).alias("text")) for s, w, t in (("0:01", "Ann", "hi"), ("0:02", None, "who"), ("0:03", "Ann", "me"))))
    row = spark.range(1).select(
        M.event_text(F.lit("Sync"), F.lit("9"), none, none, people, none, F.lit("notes")).alias("e"), M.meeting_text(F.lit("Call"), none, turns, F.lit("short"), F.array().cast("array<string>")).alias("m"), M.first_speakers(turns).alias("s")
    ).first()
    assert row["e"]["text"] == "Event: Sync\nStart: 9\nAttendees: Ann, Bo\n\nnotes" and row["e"]["text"][row["e"]["description_start"] :] == "notes"
    text = row["m"]["text"]
    assert text[row["m"]["transcript_start"] : row["m"]["transcript_end"]] == "[0:01] Ann: hi\n\n[0:02] Unknown: who\n\n[0:03] Ann: me" and text.endswith("Summary (secondary):\nshort")
    assert row["s"] == ["Ann"]


def test_recorded_pages_and_ingest(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for k in range(3):
        (pages / f"{k}.json").write_text(json.dumps({"items": [{"id": f"a{k}", "kind": "doc"}, {"id": "same", "kind": "doc"}], "next": k + 1}))
    spark.dataSource.register(RecordedPages)
    assert spark.read.format("recorded_pages").option("path", f"file://{pages}").load().count() == 6
    arrived = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "id int, ts timestamp")
    arrived.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, ts timestamp").parquet(str(tmp_path / "in"))
    for turn in ("one", "two"):  # a second run from the start finds everything there
        Z.ingest(stream(), ["id"], str(tmp_path / "out"), str(tmp_path / turn)).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = Z.deduplicated(stream(), ["id"], "ts").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kept").count() == 2


def test_pages_follow_their_tokens(spark, tmp_path):
    pages, rows = tmp_path / "pages", lambda frame: sorted((r["page"], r["external_id"]) for r in frame.collect())
    pages.mkdir()
    write = lambda name, ids, token: (pages / f"{name}.json").write_text(json.dumps({"items": [{"id": i} for i in ids], "next": token}))
    write("a", ["1", "2"], "z")
    write("z", ["3"], "m")
    write("stray", ["9"], None)
    spark.dataSource.register(RecordedPages)
    source = f"file://{pages}"
    read = lambda: rows(spark.read.format("recorded_pages").option("path", source).load())
    assert read() == [(0, "1"), (0, "2"), (1, "3")] and not full_pass(source)

    def replay():
        q = spark.readStream.format("recorded_pages").option("path", source).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return rows(spark.read.parquet(str(tmp_path / "out")))

    assert replay() == [(0, "1"), (0, "2"), (1, "3")]
    write("m", ["4"], None)
    assert full_pass(source) and replay() == read() == [(0, "1"), (0, "2"), (1, "3"), (2, "4")]  # it went on behind the last page


def test_services(spark):
    native = "application/vnd.google-apps."
    listed = [("r", "f1", native + "folder"), ("f1", "f2", native + "folder"), ("f2", "f1", native + "folder"), ("r", "a", "text/plain"), ("f2", "b", native + "document"), ("f2", "c", native + "spreadsheet"), ("other", "d", "text/plain")]
    listing = spark.createDataFrame(listed, "parent_id string, id string, mime string")
    roots = spark.createDataFrame([("r",)], "folder_id string")
    assert {tuple(r) for r in SERVICES.folder_tree(listing, roots).collect()} == {("r", 0), ("f1", 1), ("f2", 2)}
    assert {(r["id"], r["how"]) for r in SERVICES.drive_files(listing, roots).collect()} == {("a", "download"), ("b", "export")}
    asks = spark.createDataFrame([('my "x"', "from:a", dt.datetime(2024, 3, 2, 1)), (None, "q", None), ("l", "", dt.datetime(2024, 3, 2, 23))], "l string, q string, t timestamp")
    assert [r[0] for r in asks.select(SERVICES.mail_query(F.col("l"), F.col("q"), SERVICES.mail_since(F.col("t")))).collect()] == ['label:"my \\"x\\"" (from:a) after:2024/02/29', "(q)", 'label:"l" after:2024/02/29']
    got = SERVICES.mail_messages(spark.createDataFrame([("a",), ("b",), ("c",)], "message_id string"), spark.createDataFrame([("a", 200), ("b", 404), ("c", 403)], "message_id string, status int"))
    assert [r["message_id"] for r in got.collect()] == ["a"]
    day = lambda m, d: dt.datetime(2024, m, d)
    events = spark.createDataFrame([(1, day(1, 1), day(1, 2)), (2, day(5, 30), day(6, 2)), (3, day(6, 3), None), (4, day(7, 30), day(8, 1))], "id int, start timestamp, end timestamp")
    assert [r["id"] for r in SERVICES.scanned(events, F.lit(day(6, 11)), 10, 30).orderBy("id").collect()] == [2, 3]
    for back, ahead in ((0, 90), (731, 90), (180, 366)):
        with pytest.raises(ValueError):
            SERVICES.scan_window(F.lit(day(1, 1)), back, ahead)
    tries = spark.createDataFrame([(429, 1, "7", 0.5), (503, 3, None, 0.5), (503, 9, "Wed, 21 Oct", 1.0), (503, 5, "-3", 0.5), (404, 1, None, 0.5), (200, 1, None, 0.5)], "s int, n int, after string, share double")
    out = tries.select(SERVICES.retry_fate(F.col("s"), F.col("n")), SERVICES.retry_delay(F.col("n"), F.col("after"), F.col("share"))).collect()
    assert [tuple(r) for r in out] == [("retry", 7.0), ("retry", 1.0), ("fail", 20.0), ("fail", 0.0), ("fail", 0.25), ("ok", 0.25)]


def test_one_bad_item_does_not_end_a_run(spark):
    t = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, n string")
    got = Z.isolated(t, {"missing": F.col("n").isNotNull(), "no_number": F.try_to_number("n", F.lit("9")).isNotNull()})
    assert {r["id"]: r["error_class"] for r in got.collect()} == {1: None, 2: "no_number", 3: "missing"}


def test_run_status(spark):
    t = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("c", 1, True), ("c", 2, False)], "run string, at int, bad boolean")
    got = {r["run"]: (r["status"], r["success_at"]) for r in Z.run_status(t, "run", F.col("bad"), "at").collect()}
    assert got == {"a": ("completed", 1), "b": ("failed", None), "c": ("partial", 2)}
