"""Files, streams and the shared folder."""

import csv
import json

from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import score as S
from tracemill.plans import standins as I
from tracemill.session import drop_table, shared_dir, through_table
from tracemill.sources import csvsplit, files
from tracemill.streaming import jobs
from conftest import SF


def write_csv(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL)
        w.writerows(rows)


def test_queries_csv(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    answers = [[], ["a.b.func(x=\"1\")"], ["it's", 'say "hi"', "two\nlines", "back\\slash"], ["é"]]
    write_csv(path, [["query", "answer", "domains"]] + [[f"q {i}\nmore, \"x\"", repr(a), "['crm']"] for i, a in enumerate(answers)])
    rows = files.read_queries(spark, path).orderBy("seq").collect()
    assert [r["answer"] for r in rows] == answers
    assert rows[0]["query"] == 'q 0\nmore, "x"' and rows[0]["domains"] == ["customer_relationship_manager"]
    assert [r["answer"] for r in files.read_queries(spark, path, first=2).orderBy("seq").collect()] == answers[:2]


def _odd_csv(rng, path, ends, quoting):
    """A file of odd fields and blank lines; its rows as the csv module reads them."""
    field = lambda: "".join(rng.choices(["a", " ", '"', ",", "\n", "\r\n", "é", "xxxxx", "'", "\\"], k=rng.randint(0, 25)))
    with open(path, "w", newline="") as f:
        w = csv.writer(f, quoting=quoting, lineterminator=ends)
        w.writerow(["query\nof", "answer", "domains"])
        for i in range(60):
            w.writerow([field(), field(), "z\n" * 700 if i == 20 else f"r{i}"])
            if i % 7 == 0:
                f.write(ends)
    return [r for r in csv.reader(open(path, newline=""))][1:]


def test_csv_with_line_breaks_in_fields_is_read_by_several_tasks(spark, tmp_path):
    import random

    rng = random.Random(5)
    kinds = [("\n", csv.QUOTE_ALL), ("\r\n", csv.QUOTE_ALL), ("\n", csv.QUOTE_MINIMAL)]
    want = [r for i, (e, q) in enumerate(kinds) for r in _odd_csv(rng, f"{tmp_path}/f{i}.csv", e, q) if r]
    (tmp_path / "g_header_only.csv").write_text("query,answer,domains\n")
    (tmp_path / "h_empty.csv").write_text("")
    (tmp_path / "i_bom.csv").write_text("\ufeffquery,answer,domains\na,b,c", encoding="utf-8")
    want.append(["a", "b", "c"])
    confs = {"spark.sql.files.maxPartitionBytes": "257", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        assert csvsplit._splits(csvsplit._lines(spark, str(tmp_path))).where("_file like '%f1.csv'").count() > 10
        got = csvsplit.read_csv(spark, str(tmp_path), schemas.QUERIES_CSV).orderBy("seq").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    assert [r.seq for r in got] == list(range(len(want)))
    assert [[x or "" for x in (r.query, r.answer, r.domains)] for r in got] == want


def test_a_field_that_is_never_closed_reaches_to_the_end(spark, tmp_path):
    (tmp_path / "q.csv").write_text('query,answer,domains\n"a",b,c\n"d\ne,f')
    got = csvsplit.read_csv(spark, str(tmp_path / "q.csv"), schemas.QUERIES_CSV).orderBy("seq").collect()
    assert len(got) == 2 and got[0].query == "a" and got[1].seq == 1 and "d\ne,f" in got[1].query


def test_unreadable_literal_is_null(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    write_csv(path, [["query", "answer", "domains"], ["q", "[oops", "[]"], ["p", "('a', 1)", "[]"]])
    assert [r["answer"] for r in files.read_queries(spark, path).orderBy("seq").collect()] == [None, ["a", "1"]]


def test_history(spark, tmp_path):
    calls = [["f(\"x\")", "it's"], [], ["a\nb\\n"]]
    df = spark.createDataFrame(
        [(f"q{i}", c, "line\n\"quoted\", x", "" if i else None) for i, c in enumerate(calls)],
        "query string, function_calls array<string>, full_response string, error string",
    )
    root = str(tmp_path / "results")
    files.export_results(df, root, "email", "m-7b", "domains_plan_then_act", "2024-01-02_03-04-05")
    # A file written by one process, not by Spark, is part of the same history.
    (tmp_path / "results" / "calendar").mkdir()
    write_csv(f"{root}/calendar/m_all_2024-02-03_04-05-06.csv",
              [["query", "function_calls", "full_response", "error"], ["z", str(["a", "b'c"]), "", "bad"]])
    got = {r["query"]: r for r in files.read_history(spark, root).collect()}
    assert [got[f"q{i}"]["function_calls"] for i in range(3)] == calls
    assert got["q0"]["full_response"] == 'line\n"quoted", x' and got["q0"]["error"] == ""
    assert (got["q1"]["domain"], got["q1"]["label"], got["q1"]["mode"], got["q1"]["time"]) == (
        "email", "m-7b", "domains_plan_then_act", "2024-01-02_03-04-05")
    z = got["z"]
    assert (z["domain"], z["label"], z["mode"], z["function_calls"], z["error"]) == ("calendar", "m", "all", ["a", "b'c"], "bad")


def test_episode_store_is_idempotent(spark, tmp_path):
    def eps(ids):
        return spark.createDataFrame([("r", i, f"q{i}", [("t", [("k", "v")], "o")], "done", True) for i in ids], schemas.EPISODES)

    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        assert files.read_episodes(spark, path, fmt).count() == 0
        for ids in ([1, 2, 2], [2, 3], [2, 3], []):
            files.append_episodes(eps(ids), path, fmt)
        rows = files.read_episodes(spark, path, fmt).orderBy("seq").collect()
        assert [r["seq"] for r in rows] == [1, 2, 3] and rows[0]["actions"][0]["args"][0]["value"] == "v"


def test_example_file(spark, tmp_path):
    path = tmp_path / "ex.json"
    path.write_text(json.dumps([
        {"domains": ["email", "crm"], "pos": 1, "query": "q", "actions": [{"name": "t", "args": []}], "final_answer": "x"},
        {"domains": ["customer_relationship_manager", "email"], "pos": 2, "query": "p", "actions": [], "final_answer": "y"},
    ], indent=1))
    rows = files.read_examples(spark, str(path)).collect()
    assert {r["domain_key"] for r in rows} == {"customer_relationship_manager|email"} and len(rows) == 2


def test_stream_equals_batch(spark, tmp_path):
    args = (I.gold(spark, SF), I.tools(spark), I.base_state(spark, SF))
    results = I.results(spark, SF).where("query_id < 40")
    path = str(tmp_path / "in")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    flags = ["run_id", "query_id", "correct", "exact_match", "unwanted_side_effects"]
    read = lambda: sorted(map(tuple, spark.read.parquet(out).select(*flags).collect()))
    run = lambda: jobs.score_stream(jobs.result_stream(spark, path, 1), *args, out, check).awaitTermination()
    first, second = results.where("query_id % 2 = 0"), results.where("query_id % 2 = 1")
    first.coalesce(2).write.parquet(path)
    run()
    assert len(read()) == first.count()
    second.coalesce(1).write.mode("append").parquet(path)
    run()
    batch = sorted(map(tuple, S.score(results, *args).select(*flags).collect()))
    assert read() == batch


def _episode_rows(spark, seqs, text="add the row"):
    call = [("add", [("k", "1")], "ok")]
    rows = [("a", i, f"{text} {i}", call, "done", ["add"], "", 1, i % 4 != 0, 1) for i in seqs]
    kind = ("run_id string, seq long, query string, actions array<struct<name string, args array<struct<name string, value string>>, observation string>>, "
            "final_answer string, available array<string>, error string, n_actions long, same_outcome boolean, n_gold long")
    return spark.createDataFrame(rows, kind)


def test_store_keeps_each_episode_once_and_reads_nothing_back(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    stream = lambda: spark.readStream.schema(_episode_rows(spark, []).schema).parquet(f"{root}/in")
    monkeypatch.setattr(files, "read_episodes", lambda *a, **k: (_ for _ in ()).throw(AssertionError("the store was read")))
    for seqs in (range(10), [*range(5, 15), *range(5, 15)], range(3)):
        _episode_rows(spark, seqs).write.mode("append").parquet(f"{root}/in")
        jobs.keep_episodes(stream(), f"{root}/store", f"{root}/check").awaitTermination()
    monkeypatch.undo()
    stored = lambda **k: sorted(r.seq for r in files.read_episodes(spark, f"{root}/store", **k).collect())
    assert stored() == [i for i in range(15) if i % 4]
    assert stored(before=1) == [i for i in range(10) if i % 4] and stored(before=0) == []
    # A batch that is written again replaces its version; one that is not complete is not seen.
    files.write_version(through_table(files.read_episodes(spark, f"{root}/store", before=1)), f"{root}/store", 0)
    assert stored() == [i for i in range(15) if i % 4]
    again = _episode_rows(spark, [99]).withColumn("verified", F.lit(True)).select(*schemas.EPISODES.names)
    again.write.parquet(f"{root}/store/batch=77")
    assert 99 not in stored(before=100) and files.store_version(spark, f"{root}/store") in (1, 2)


def test_retrieval_sees_earlier_batches_only_also_after_a_retry(spark, tmp_path):
    root, work = str(tmp_path), []
    kept = jobs._run
    jobs._run = lambda stream, do, check: work.append(do) or kept(stream, do, check)
    try:
        for seqs in ([1, 2, 3], [5, 6, 2]):
            _episode_rows(spark, seqs).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(_episode_rows(spark, []).schema).parquet(f"{root}/in")
            jobs.retrieve_and_keep(stream, f"{root}/store", f"{root}/out", f"{root}/check", 2).awaitTermination()
    finally:
        jobs._run = kept
    picks = lambda: sorted((r.batch, r.seq, r.e_seq) for r in spark.read.parquet(f"{root}/out").select("batch", "seq", "e_seq").collect())
    seen = picks()
    assert {b for b, _, _ in seen} == {1} and {s for _, s, _ in seen} == {5, 6} and {e for _, _, e in seen} <= {1, 2, 3}
    # The second batch runs once more, although its own episodes are in the store by now.
    work[-1](_episode_rows(spark, [5, 6]), 1)
    assert picks() == seen
    assert sorted(r.seq for r in files.read_episodes(spark, f"{root}/store").collect()) == [1, 2, 3, 5, 6]


def test_written_table_keeps_rows(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(5).withColumn("x", F.array(F.col("id")))
    assert through_table(df).orderBy("id").collect() == df.orderBy("id").collect()


def test_first_rows_follow_the_files(spark, tmp_path):
    for part, rows in (("a", range(0, 10)), ("b", range(10, 4000)), ("c", range(4000, 4100))):
        (tmp_path / f"{part}.csv").write_text("query,answer,domains\n" + "".join(f'"q{i:06d}","[]","[\'email\']"\n' for i in rows))
    got = files.read_queries(spark, str(tmp_path))
    assert [(r.seq, r.query) for r in got.orderBy("seq").collect()] == [(i, f"q{i:06d}") for i in range(4100)]
    assert sorted(r.query for r in files.read_queries(spark, str(tmp_path), first=12).collect()) == [f"q{i:06d}" for i in range(12)]


def test_dropped_tables_are_gone(spark):
    import os

    one, other = through_table(spark.range(5)), through_table(spark.range(7))
    folder = one.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    drop_table(one)
    drop_table(through_table(spark.range(0)))
    assert not os.path.exists(folder) and other.count() == 7
