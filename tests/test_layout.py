import random

from pyspark.sql import functions as F

from ledgerloom.operators import layout
from ledgerloom.operators.segments import BOUNDARY, page_signals, segment_pages

SCHEMA = "doc_id bigint, page int, line_no int, seq int, text string, x1 int, y1 int, x2 int, y2 int"


def test_greedy_lines_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(1, 1, 0, i, "w", x := rnd.randrange(900), y := rnd.randrange(200), x + 40, y + rnd.randrange(8, 30)) for i in range(60)]
    got = {r.seq: r.cluster for r in layout.greedy_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    lines, want = [], {}
    for r in sorted(rows, key=lambda r: (r[6], r[5], r[3])):
        for i, (t, b) in enumerate(lines):
            low = max(1, min(b - t, r[8] - r[6]))
            if (min(b, r[8]) - max(t, r[6])) / low >= 0.45 or abs((t + b) / 2 - (r[6] + r[8]) / 2) <= 0.45 * low:
                lines[i] = (min(t, r[6]), max(b, r[8]))
                want[r[3]] = i
                break
        else:
            lines.append((r[6], r[8]))
            want[r[3]] = len(lines) - 1
    assert got == want


def test_tokens_keep_whole_texts(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    t = layout.tokens_of(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n ")], "doc_id bigint, text string"))
    assert t.count() == 5000
    back = layout.rebuild_text(t).orderBy("page").select(F.regexp_replace("page_text", "\n", " ").alias("p")).collect()
    assert " ".join(r.p for r in back) == text


def test_segments_forget_at_a_split(spark):
    pages = [
        (1, 1, "TAX INVOICE invoice no: A-1001 total"), (1, 2, "continued goods"), (1, 3, "TAX INVOICE invoice no: B-2002"), (1, 4, "invoice no: B-2002"), (1, 5, "TAX INVOICE invoice no: A-1001"),
    ]
    got = [(r.page, r.segment) for r in segment_pages(page_signals(spark.createDataFrame(pages, "doc_id bigint, page int, page_text string"))).orderBy("page").collect()]
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)] and BOUNDARY == 0.40


def test_spans_and_chunks(spark):
    df = spark.createDataFrame([(1, i, x, 0.5) for i, x in enumerate(["B-A", "I-A", "O", "I-A", "B-B", "I-A", "B-A"])], "doc_id bigint, seq int, label string, confidence double")
    got = sorted((r["from_seq"], r["to_seq"], r["kind"]) for r in layout.bio_spans(df).collect())
    assert got == [(0, 1, "A"), (3, 3, "A"), (4, 4, "B"), (5, 5, "A"), (6, 6, "A")]
    votes = layout.chunk_votes(df, 4, 2).collect()
    assert len(votes) == 7 and {r.seq: r.label for r in votes}[2] == "O"


def test_tags_take_a_token_once(spark):
    from ledgerloom.operators.extraction import tag_tokens

    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("Invoice A-17 dated 1 May A-17 Total".split())] + [(2, 0, "x")], "doc_id bigint, seq int, text string")
    v = spark.createDataFrame([(1, "number", "a17", 0), (1, "order", "A-17", 1), (1, "date", "1 May", 2), (1, "none", "zzz", 3)], "doc_id bigint, field string, value string, ord int")
    got = {(r.doc_id, r.seq): r.label for r in tag_tokens(t, v).collect()}
    assert [got[(1, i)] for i in range(7)] == ["O", "B-number", "O", "B-date", "I-date", "B-order", "O"] and got[(2, 0)] == "O"
