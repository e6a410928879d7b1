import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tunedata.operators.rewards import best_of_n
from tunedata import session
from tunedata.operators import distribution as ds, hooks, indexing as ix, monitoring as mn
from tunedata.operators.normalise import normalise_sft
from tunedata.plans import registry as rg, streams  # noqa: F401
from tunedata.sources import ledger, readers as rd
from tunedata.sources.json_lists import read_json_list
from tunedata.sources import writers as wr
from tunedata.streaming import averages as av, monitors as st


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        rd.read_corpus(spark, str(tmp_path / "x.avro"))
    with pytest.raises(ValueError):
        rd.read_named(spark, str(tmp_path), "a@b@c")


def test_json_array_is_one_valid_list_per_file(spark, tmp_path):
    path = wr.write_json_array(spark.range(100).repartition(3), str(tmp_path / "a"))
    lists = [json.loads(p.read_text()) for p in sorted((tmp_path / "a").glob("part-*"))]
    assert sorted(r["id"] for rows in lists for r in rows) == list(range(100))
    assert rd.read_json_array(spark, path, "id bigint").count() == 100


SIGNS = ["{", "}", "[", "]", '"', "\\", ",", ":", "a", "é", "\n", "}{", '\\"', "日", " "]


def test_one_list_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Brackets, quotes and line breaks within strings, nested records; every cut by bytes gives the reading of one task."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randrange(12)))
    rows = [{"id": i, "t": text(), "o": {"k": text(), "l": [text(), text()]}, "p": [{"x": text()} for _ in range(rng.randrange(3))]} for i in range(400)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps(rows[:350], indent=rng.choice([None, 2]), ensure_ascii=False))
    (tmp_path / "j" / "b.json").write_text(" [\n" + ",\n".join(json.dumps(r) for r in rows[350:]) + "]\n")
    (tmp_path / "j" / "c.json").write_text("[]")
    (tmp_path / "j" / "d.json").write_text("")
    schema = "id bigint, t string, o struct<k string, l array<string>>, p array<struct<x string>>"
    whole = sorted(json.dumps(r, sort_keys=True) for r in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, hot in (("4096", 250_000), ("1000", 50), ("128m", 250_000)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            monkeypatch.setattr(ix, "RANGE_ROWS", hot)
            monkeypatch.setattr(ix, "RANGES", 6)
            got = read_json_list(spark, str(tmp_path / "j"), schema).collect()
            assert sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in got) == whole
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "j" / "a.json")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = rd.read_json_array(spark, str(tmp_path / "j" / "a.json"), schema)
    assert one.exceptAll(read_json_list(spark, str(tmp_path / "j" / "a.json"), schema)).count() == 0


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\n"b", c')], "id int, t string")
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "x.csv"))
    assert rd.read_corpus(spark, str(tmp_path / "x.csv"), "id int, t string", multi_line=True).first().t == 'a\n"b", c'


def test_exam_subject_from_file_name(spark, tmp_path):
    (tmp_path / "law_val.csv").write_text("id,question\n1,q\n")
    (tmp_path / "art.csv").write_text("id,question\n2,r\n")
    got = {r.id: r.subject for r in rd.read_exams(spark, str(tmp_path), "id int, question string").collect()}
    assert got == {1: "law", 2: "art"}


def test_latest_snapshot_and_pruning(spark, tmp_path):
    path = str(tmp_path / "s")
    for step in (10, 200, 30):
        wr.write_snapshot(spark.range(2).withColumn("logit", F.lit(float(step))), path, run="r", step=step)
    assert {r.logit for r in rd.latest_snapshot(rd.read_snapshots(spark, path)).collect()} == {200.0}
    assert rd.curve_steps(10) == list(range(60, 201, 10))
    plan = rd.read_snapshots(spark, path, [10, 30])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [step" in plan
    empty = rd.read_snapshots(spark, path, [999])
    assert rd.latest_snapshot(empty).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))
    conf = spark.conf.get("spark.checkpoint.dir", None)
    assert conf is None or session.shared_dir(spark) == conf.rstrip("/")


def _feed(spark, folder, batches, schema):
    """One file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


def test_streaming_ema_over_batches_with_a_late_step(spark, tmp_path):
    batches = [[("a", 2, 2.0), ("a", 1, 1.0), ("b", 5, 1.0)], [("a", 2, 100.0), ("a", 3, 3.0)]]
    stream = _feed(spark, str(tmp_path / "in"), batches, "run string, step bigint, value double")
    out = str(tmp_path / "out")
    av.start_ema(stream, out, str(tmp_path / "cp"), run="run", step="step", value="value").awaitTermination()
    got = {(r.run, r.step): r.ema for r in av.read_ema(spark, out).collect()}
    e1 = 0.05
    e2 = e1 * 0.95 + 0.05 * 2
    want = {("a", 1): e1, ("a", 2): e2, ("a", 3): e2 * 0.95 + 0.15, ("b", 5): 0.05}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert [tuple(r) for r in av.read_late(spark, out).collect()] == [("a", 2, 100.0)]


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_streaming_ema_is_that_of_the_table_however_it_is_cut(spark, tmp_path, monkeypatch, cut):
    """Rows shuffled within the delay, one hot run over many ranges, a null run; the batch operator gives the same."""
    monkeypatch.setattr(ix, "RANGES", 5)
    rng = random.Random(cut)
    rows = [("hot" if i % 3 else [None, "b", "c"][i // 3 % 3], i, float(rng.randrange(100))) for i in range(240)]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(20))
    size = -(-len(late) // cut)
    schema = "run string, step bigint, value double"
    stream = _feed(spark, str(tmp_path / "in"), [late[i:i + size] for i in range(0, len(late), size)], schema)
    out = str(tmp_path / "out")
    av.start_ema(stream, out, str(tmp_path / "cp"), run="run", step="step", value="value", decay=0.3, delay=20).awaitTermination()
    batch = mn.ema(spark.createDataFrame(rows, schema), "value", step="step", by=["run"], decay=0.3)
    want = {(r.run, r.step): r.ema for r in batch.collect()}
    got = {(r.run, r.step): r.ema for r in av.read_ema(spark, out, decay=0.3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert av.read_late(spark, out).count() == 0
    assert av.read_ema(spark, out, flush=False).count() < len(rows)


def test_batches_are_added_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id bigint"
    assert ledger.read_batches(spark, path, schema).count() == 0
    assert ledger.add_batch(spark.range(5), path, query="q", batch=0)
    assert not ledger.add_batch(spark.range(5), path, query="q", batch=0)
    ledger.stage(spark.range(100), path, query="q", batch=1)  # a write that was never committed
    assert ledger.add_batch(spark.range(3), path, query="q", batch=1)
    assert ledger.add_batch(spark.range(2), path, query="r", batch=1)
    twice = ledger.stage(spark.range(2), path, query="r", batch=1)
    ledger.commit(spark, path, twice, query="r", batch=1)  # two writers at once
    rows = ledger.read_batches(spark, path, schema)
    assert sorted((r.query, r.batch, r["count"]) for r in rows.groupBy("query", "batch").count().collect()) == [("q", 0, 5), ("q", 1, 3), ("r", 1, 2)]


def test_a_stream_that_fails_after_writing_leaves_no_doubles(spark, tmp_path, monkeypatch):
    """The second micro-batch is written and its commit lost; a restart writes it again."""
    batches = [[("r", i, "loss", float(i)) for i in range(n, n + 4)] for n in (0, 4, 8)]
    schema = "run string, step bigint, metric string, value double"
    path, checkpoint = str(tmp_path / "m"), str(tmp_path / "cp")
    commit, seen = ledger.commit, []

    def lost(spark, path, attempt, *, query, batch):
        seen.append(batch)
        if seen == [0, 1]:
            raise OSError("the machine went away")
        commit(spark, path, attempt, query=query, batch=batch)

    monkeypatch.setattr(ledger, "commit", lost)
    folder = str(tmp_path / "in")
    with pytest.raises(Exception, match="went away"):
        wr.start_metrics(_feed(spark, folder, batches, schema), path, checkpoint, query="q").awaitTermination()
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    wr.start_metrics(reader.parquet(folder), path, checkpoint, query="q").awaitTermination()
    assert sorted(tuple(r) for r in wr.read_metrics(spark, path).collect()) == sorted(sum(batches, []))
    assert seen == [0, 1, 1, 2] and len(list((tmp_path / "m" / "rows").glob("attempt=*"))) == 4


def test_histograms_of_a_stream_are_those_of_its_rows(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.randrange(3), rng.random()) for _ in range(50)] for _ in range(4)]
    stream = _feed(spark, str(tmp_path / "in"), batches, "g bigint, v double")
    path = str(tmp_path / "h")
    st.start_histograms(stream, path, str(tmp_path / "cp"), query="q", value="v", by=["g"]).awaitTermination()
    again = spark.readStream.schema("g bigint, v double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.start_histograms(again, path, str(tmp_path / "cp2"), query="q", value="v", by=["g"]).awaitTermination()
    whole = spark.createDataFrame(sum(batches, []), "g bigint, v double")
    want = {(r.g, r.bin): r.n for r in ds.histogram(whole, "v", 7, step="g").collect()}
    assert {(r.g, r.bin): r.n for r in st.read_histograms(spark, path, 7, by=["g"]).collect()} == want


def test_a_step_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in (5, 5, 3):
        wr.write_snapshot(spark.range(n).withColumn("logit", F.lit(1.0)), path, run="r", step=10)
        wr.write_snapshot(spark.range(2).withColumn("logit", F.lit(1.0)), path, run="q", step=10)
    assert {r.run: r["count"] for r in rd.read_snapshots(spark, path).groupBy("run").count().collect()} == {"r": 3, "q": 2}
    wr.write_snapshot(spark.range(4).withColumn("logit", F.lit(1.0)), path, run="r", step=9)
    assert rd.read_latest(spark, path).count() == 5
    with pytest.raises(Exception):
        rd.read_latest(spark, str(tmp_path / "none"))


def test_streaming_best_of_n_equals_batch(spark, tmp_path):
    batches = [[("a", 0, "x", 1.0), ("b", 1, "y", 2.0)], [("a", 2, "z", 1.0), ("b", 3, "w", 5.0)], [("a", 4, "u", 0.5)]]
    stream = _feed(spark, str(tmp_path / "in"), batches, "input string, pos bigint, output string, reward double")
    best = st.stream_best_of_n(stream, key="input", output="output", score="reward", pos="pos")
    st.run_to_end(best, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update")
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert {r.input: r.output for r in st.newest_rows(rows, ["input"]).collect()} == {"a": "x", "b": "w"}


def test_streaming_best_of_n_without_numbers(spark, tmp_path):
    nan = float("nan")
    batches = [[("a", 0, "x", 1.0), ("b", 1, "y", nan)], [("a", 2, "z", nan), ("b", 3, "w", 5.0)], [("a", 4, "u", 0.5)]]
    schema = "input string, pos bigint, output string, reward double"
    stream = _feed(spark, str(tmp_path / "in"), batches, schema)
    best = st.stream_best_of_n(stream, key="input", output="output", score="reward", pos="pos")
    st.run_to_end(best, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update")
    rows = st.newest_rows(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")), ["input"])
    got = sorted((r.input, r.output, r.first_pos) for r in rows.collect())
    assert got == [("a", "x", 0), ("b", "y", 1)]
    batch = best_of_n(spark.createDataFrame(sum(batches, []), schema))
    assert got == sorted((r.input, r.output, r.first_pos) for r in batch.collect())


def test_streaming_normalise_keeps_no_state(spark, tmp_path):
    stream = _feed(spark, str(tmp_path / "in"), [[("i", "o")], [(None, "o")]], "input string, output string")
    st.run_to_end(normalise_sft(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.shape for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["io_pair", "unknown"]


@pytest.mark.parametrize("parts", [None, 1, 3])
def test_a_table_of_one_file_or_of_a_folder_is_streamed(spark, tmp_path, parts):
    """The stream's rows are those of the table, and those of no other one, whatever its files are called."""
    schema = "doc_id bigint, text string, lang string"
    docs = [(i, f"word {i}", "en") for i in range(1, 20)] + [(20, None, "en"), (21, "x", None)]
    for name, rows in (("documents", docs), ("documents.parquet.old", docs[:3]), ("other", docs[:5])):
        target = tmp_path / "in" / f"{name}.parquet"
        made = tmp_path / "made" / name if parts is None else target
        spark.createDataFrame(rows, schema).repartition(parts or 1).write.parquet(str(made))
        if parts is None:
            target.parent.mkdir(exist_ok=True)
            target.write_bytes(next(made.glob("part-*.parquet")).read_bytes())
    sf_dir = str(tmp_path / "in")
    st.run_to_end(rg.stream(spark, sf_dir, "documents"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.doc_id) == [tuple(r) for r in docs]
    got = rg.QUERIES["st_normalise"].build(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(1, 20) if i % 7]


def test_a_partitioned_table_is_streamed_with_its_column(spark, tmp_path):
    rows = [(i, f"g{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "v bigint, g string").write.partitionBy("g").parquet(str(tmp_path / "t.parquet"))
    st.run_to_end(rg.stream(spark, str(tmp_path), "t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == rows


def test_hooks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "")], "id int, t string")
    said = hooks.generate(df, "t", lambda: "!", lambda model, batch: batch + model)
    assert [r.output for r in said.collect()] == ["ab!", "!"]

    def check(_, texts):
        if (texts == "").any():
            raise RuntimeError("nothing to read")
        return pd.Series(["safe"] * len(texts))

    got = hooks.guard_verdicts(df, "t", lambda: None, check).collect()
    assert [(r.verdict, r.error) for r in got] == [("safe", None), (None, "RuntimeError: nothing to read")]
    ids = df.select(hooks.tokens(F.col("t"), lambda s: s.map(lambda t: [ord(c) for c in t])).alias("i")).collect()
    assert [r.i for r in ids] == [[97, 98], []]
    scores = hooks.label_scores(df, "t", lambda: 2.0, lambda m, b: pd.Series([[m] * 3 for _ in b]))
    assert scores.first().logits == [2.0, 2.0, 2.0]


TEXTS = ["a" * 30, "é" * 20, "", None, "b" * 500, None, None, "c" * 60, "日" * 33, "d"] * 20


def _given(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").coalesce(1)


def _sizer():
    """Bytes of some texts, as a function that travels to the workers by value."""
    return lambda texts: sum(len((t or "").encode()) for t in texts)


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_a_scorer_gets_few_bytes_at_once(spark, monkeypatch, size):
    """The scores of each text are its own, in one load, whatever the texts are cut into; a long text stands alone."""
    monkeypatch.setattr(hooks, "BATCH_BYTES", size)
    total = _sizer()

    def run(loads, texts):
        loads.append(len(texts))
        return pd.Series([[-1 if t is None else len(t), len(texts), total(texts), sum(loads)] for t in texts])

    got = hooks.label_scores(_given(spark), "t", list, run).orderBy("id").collect()
    assert [r.logits[0] for r in got] == [-1 if t is None else len(t) for t in TEXTS]
    assert all(r.logits[2] <= max(size, total([TEXTS[r.id]])) for r in got)
    assert got[-1].logits[3] == len(TEXTS)
    verdicts = hooks.guard_verdicts(_given(spark), "t", lambda: None, lambda _, texts: texts.map(lambda t: f"{total(texts) <= max(size, 500)}")).collect()
    assert {(r.verdict, r.error) for r in verdicts} == {("True", None)}
    ids = _given(spark).select("id", hooks.tokens(F.col("t"), lambda s: s.map(lambda t: None if t is None else list(t.encode()))).alias("i"))
    assert [None if r.i is None else bytes(r.i).decode() for r in ids.orderBy("id").collect()] == TEXTS


def test_too_few_scores_are_an_error(spark):
    with pytest.raises(Exception, match="1 outputs for 2 inputs"):
        hooks.label_scores(spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1), "t", lambda: 0, lambda m, b: pd.Series([[1.0]])).collect()


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_a_generator_gets_few_bytes_at_once(spark, monkeypatch, size):
    monkeypatch.setattr(hooks, "BATCH_BYTES", size)
    total = _sizer()

    def run(mark, prompts):
        return prompts.map(lambda t: None if t is None else f"{t}{mark}{total(prompts)}")

    got = hooks.generate(_given(spark), "t", lambda: "!", run).orderBy("id").collect()
    parts = [(None, 0) if r.output is None else (r.output.split("!")[0], int(r.output.split("!")[1])) for r in got]
    assert [t for t, _ in parts] == TEXTS
    assert all(n <= max(size, total([t])) for t, n in parts)


@pytest.mark.parametrize("bad", [[], [0], [77], [5, 6, 99], list(range(0, 100, 9)), list(range(100))])
def test_failing_texts_are_found_by_halving(bad):
    calls = []

    def check(_, texts):
        calls.append(len(texts))
        if texts.isin([f"t{i}" for i in bad]).any():
            raise RuntimeError("no")
        return texts.str.upper()

    got = hooks.judged(None, check, pd.Series([f"t{i}" for i in range(100)]))
    assert got["verdict"].tolist() == [None if i in bad else f"T{i}" for i in range(100)]
    assert got["error"].tolist() == ["RuntimeError: no" if i in bad else None for i in range(100)]
    assert len(calls) <= 1 + 2 * len(bad) * 7


def test_a_guard_that_returns_too_few_verdicts_fails():
    got = hooks.judged(None, lambda _, texts: texts.iloc[:0], pd.Series(["a", "b"]))
    assert got["verdict"].tolist() == [None, None] and all("0 verdicts for 1" in e for e in got["error"])
    assert len(hooks.judged(None, None, pd.Series([], dtype=object))) == 0
