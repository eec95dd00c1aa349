import hashlib

import pytest

from quern.llm.common import cut
from quern.llm.linededup import LineRuns, dedup_line_documents, dedup_lines, occurrences

WS = " \t\n\x0b\x0c\r"


def brute(rows, least_docs=3, least_chars=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(WS).translate(lower)
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    found = dedup_lines(edge_docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found.collect()), key=str) == brute(rows)
    assert dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5, 7])
def test_batches_and_compaction_change_nothing(spark, batches):
    rows = [(i, "\n".join(f"a line with number {i * k % 13} in it" for k in range(1, 9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup_lines(docs, batches=batches, fanout=2, with_text=False).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found), key=str) == brute(rows)


def test_runs_hold_a_line_once(spark):
    first = spark.createDataFrame([(1, "a line that both batches hold\nonly the first has this line")], "doc_id long, text string")
    second = spark.createDataFrame([(2, "a line that both batches hold\nonly the second has this line")], "doc_id long, text string")
    runs = LineRuns(spark, fanout=3)
    runs.add(occurrences(first))
    runs.add(occurrences(second))
    assert [run.count() for run in runs.runs()] == [2, 1] and [u.count() for u in runs.updates] == [1]
    assert sorted((r.n_docs, r.last_doc) for r in runs.merged().collect()) == [(1, 1), (1, 2), (2, 2)]
    runs.drop()


def test_levels_fill_and_no_table_stays(spark):
    before = {t.name for t in spark.catalog.listTables()}
    runs = LineRuns(spark)
    for batch in range(5):
        runs.add(occurrences(spark.createDataFrame([(batch, f"a line that all batches hold\nonly batch {batch} has this line")], "doc_id long, text string")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted((r.n_docs, r.last_doc) for r in runs.merged().collect()) == [*((1, i) for i in range(5)), (5, 4)]
    runs.drop()
    dedup_lines(spark.createDataFrame([(i, "a line that three documents hold") for i in range(3)], "doc_id long, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_documents_keep_columns_and_rows(edge_docs):
    out = dedup_line_documents(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert {r.doc_id: r.text for r in out.filter("doc_id in (1, 6, 7)").collect()} == {1: None, 6: "own line of document six is here", 7: "another"}
    assert cut(out, "x").filter("n_chars <> length(text)").count() == 0


def test_names_of_columns_do_not_clash(edge_docs):
    docs = edge_docs.withColumnsRenamed({"kept": "__id", "n_lines": "__doomed", "lang": "key", "source": "lost"})
    out = dedup_line_documents(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.filter("doc_id = 7").collect()} == {7: "another"}
