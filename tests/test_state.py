import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import state as st
from lectern.streaming import jobs
from lectern.streaming.runner import drain, latest_per_key, open_stream

T0 = dt.datetime(2024, 1, 1)


COLUMNS = ("queue string, engine string, model string, event_id bigint, ts timestamp, chars bigint, duration_ms double, "
           "ok boolean")


def samples(spark, rows):
    data = [(q, e, "m", i, T0 + dt.timedelta(seconds=s), c, float(ms), ok) for i, (q, e, s, c, ms, ok) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def test_speed_vector(spark):
    df = samples(spark, [("s", "q", 1, 100, 8500, True), ("s", "q", 2, 0, 900, True), ("s", "q", 3, 50, 3000, True),
                         ("s", "q", 4, 10, 400, True)])
    got = st.speed_average(df).collect()
    assert [(r["engine"], r["ms_per_char"], r["samples"]) for r in got] == [("q", 49.7, 3)]


def walk(rows):
    """Plain left-to-right labelling: only attempts labelled ok are samples of their engine and successes of their queue."""
    rate, seen, success = {}, {}, {}
    out = []
    for i, (q, e, s, c, ms, ok) in enumerate(rows):
        warm = q in success and s - success[q] < 600 and seen.get((q, e), 0) >= 3
        limit = max(25, 3 * (500 + c * rate.get((q, e), 80)) / 1000) if warm else 300
        label = "runaway" if ms / 1000 > limit else "ok" if ok else "fail"
        out.append((i, warm, limit, label))
        if label == "ok":
            success[q] = s
            if c > 0 and ms > 0:
                x = max(ms - 500, 0) / c
                rate[q, e] = round(x if (q, e) not in rate else 0.3 * x + 0.7 * rate[q, e], 3)
                seen[q, e] = seen.get((q, e), 0) + 1
    return out, rate, seen


def random_attempts(n=400, seed=5, span=100_000):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(span), n))
    return [(rng.choice("xxy"), rng.choice("ab"), s if i % 3 else s - s % 50, rng.randint(0, 60) * rng.choice([1, 1, 20]),
             rng.choice([0, 300, 2500, 9000, 26000, 45000, 90000, 400_000]), rng.random() < 0.8) for i, s in enumerate(at)]


@pytest.mark.parametrize("seconds", [20_000, 10**7])
def test_speed_and_labels_do_not_depend_on_the_slices(spark, seconds):
    rows = sorted(random_attempts(), key=lambda r: r[2])
    labels, rate, seen = walk(rows)
    assert sum(x[3] == "runaway" and x[1] for x in labels) > 5 and sum(x[1] for x in labels) > 50
    marked = st.label_attempts(samples(spark, rows), seconds)
    got = [(r["event_id"], r["warm"], round(r["limit_s"], 6), r["label"]) for r in marked.orderBy("event_id").collect()]
    assert got == [(i, w, round(x, 6), label) for i, w, x, label in labels]
    speeds = st.speed_average(marked.filter("label = 'ok'"), seconds).collect()
    want = {k: (rate[k], seen[k]) for k in rate}
    assert {(r["queue"], r["engine"]): (r["ms_per_char"], r["samples"]) for r in speeds} == want
    latest = st.latest_speed(marked).collect()
    assert {(r["queue"], r["engine"]): (r["ms_per_char"], r["samples"]) for r in latest} == want


def test_a_runaway_changes_no_state(spark):
    steady = [("s", "q", 60 * i, 50, 3000, True) for i in range(6)]
    runaway = ("s", "q", 360, 50, 400_000, True)
    after = ("s", "q", 420, 50, 30_000, True)
    got = st.label_attempts(samples(spark, [*steady, runaway, after])).orderBy("event_id").collect()
    assert [r["label"] for r in got] == ["ok"] * 6 + ["runaway"] * 2
    assert got[7]["rate"] == got[6]["rate"] == 50.0 and got[7]["samples"] == 6 and got[7]["last_success_at"] == T0 + dt.timedelta(seconds=300)


def test_success_of_one_engine_warms_the_queue(spark):
    rows = [("s", "a", 60 * i, 50, 3000, True) for i in range(4)] + [("s", "b", 1000, 50, 3000, True), ("s", "a", 1200, 50, 30_000, True)]
    got = st.label_attempts(samples(spark, rows)).orderBy("event_id").collect()
    assert got[5]["warm"] and got[5]["label"] == "runaway"


def folded(xs, start):
    for x in xs:
        start = st.next_rate(start, x)
    return start


@pytest.mark.parametrize("case", ["constant", "two", "random", "wide", "short"])
def test_a_stretch_is_a_small_step_function(case):
    rng = random.Random(case)
    xs = {"constant": [7.1234] * 200_000, "two": [3.3333, 3.3353] * 5000, "random": [rng.uniform(0, 400) for _ in range(3000)],
          "wide": [rng.choice([0.0, 1e8, 5.5]) for _ in range(300)], "short": [rng.uniform(0, 400) for _ in range(12)]}[case]
    low, high = (min(xs), max(xs)) if case != "constant" else (0.0, 5000.0)
    step = st.SpeedStep(low, high)
    most = 0
    for x in xs:
        step.add(x, round(round(high, 3) * 1000))
        most = max(most, len(step.seen or ()) + len(step.steps))
    fresh, seen, starts, values = step.summary()
    assert most < 100 and fresh == folded(xs, None)
    tried = [round(low, 3), round(high, 3)] + [round(rng.uniform(low, high), 3) for _ in range(3 if case == "constant" else 40)]
    tried += [round(s / 1000 + d, 3) for s in starts[:2] for d in (-0.001, 0, 0.001) if low <= s / 1000 + d <= high]
    for start in tried:
        assert st._applied(start, fresh, seen, starts, values) == folded(xs, start)


def updates(spark, rows):
    return spark.createDataFrame(
        [("m", i, int(s * 1000), int(p * 10), 1000, status) for i, (s, p, status) in enumerate(rows)],
        "key string, event_id bigint, at_ms bigint, current bigint, total bigint, status string")


def test_throttle_vector(spark):
    rows = [(0.0, 0, "d"), (0.1, 0.5, "d"), (0.2, 1.0, "d"), (0.6, 1.4, "d"), (0.8, 1.5, "d"), (0.85, 1.6, "complete")]
    got = st.throttled_progress(updates(spark, rows)).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [0, 2, 4, 5]


def test_throttle_matches_a_plain_walk(spark):
    rng = random.Random(2)
    s, p, rows = 0.0, 0.0, []
    for _ in range(500):
        s += rng.choice([0.05, 0.1, 0.2, 0.7])
        p = min(100, p + rng.choice([0, 0.1, 0.3, 1.2]))
        rows.append((round(s, 3), round(p, 1), rng.choice(["d"] * 20 + ["error"])))
    sent, last = [], None
    for i, (s, p, status) in enumerate(rows):
        at, pct = int(s * 1000), int(p * 10) / 1000 * 100
        if last is None or status == "error" or at - last[0] >= 500 or abs(pct - last[1]) >= 1:
            sent.append(i)
            last = (at, pct)
    for block in (1000, 10**9):
        got = st.throttled_progress(updates(spark, rows), block).orderBy("event_id").collect()
        assert [r["event_id"] for r in got] == sent


def plain_throttle(rows):
    sent, last = [], None
    for i, at, pct, status in rows:
        if last is None or status in ("complete", "error") or at - last[0] >= 500 or abs(pct - last[1]) >= 1:
            sent.append(i)
            last = (at, pct)
    return sent


@pytest.mark.parametrize("seed, slice_ms", [(1, 2000), (2, 2000), (3, 5000), (4, 60_000)])
def test_a_dense_run_is_cut_into_slices(spark, seed, slice_ms):
    """Updates without a pause: the first one sent in each slice follows from the links between slices."""
    rng = random.Random(seed)
    rows, at, pct = [], 10_000, 0.0
    for i in range(4000):
        at += rng.choice([0, 3, 10, 40, 499 if seed == 2 else 60])
        pct = min(100.0, max(0.0, pct + rng.choice([-0.3, 0, 0.1, 0.2, 0.4 if seed == 3 else 0.02])))
        rows.append((i, at, round(pct, 1), "error" if rng.random() < 0.0005 else "d"))
    df = spark.createDataFrame([("m", i, at, int(round(p * 10)), 1000, s) for i, at, p, s in rows],
                               "key string, event_id bigint, at_ms bigint, current bigint, total bigint, status string")
    want = plain_throttle([(i, at, int(round(p * 10)) / 1000 * 100, s) for i, at, p, s in rows])
    got = st.throttled_progress(df, slice_ms=slice_ms).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == want


def test_percent_edges(spark):
    df = spark.createDataFrame([(5, 0), (50, 100), (200, 100), (-1, 100)], "current bigint, total bigint")
    assert [r[0] for r in df.select(st.progress_percent()).collect()] == [0.0, 50.0, 100.0, 0.0]


def test_log_metrics(spark):
    lines = ["[QC] Tentative 1/20", "x (meilleur : 22%)", "tentative 2 /20 (Meilleur: 30%)", "Tentative 1/5 (meilleur : —%)",
             "rien", "meilleur : 7"]
    df = spark.createDataFrame([("q", i, T0 + dt.timedelta(seconds=i), x) for i, x in enumerate(lines)],
                               "queue string, event_id int, ts timestamp, line string")
    got = st.log_metrics(df, 2).orderBy("event_id").collect()
    assert [(r["series"], r["attempt"], r["best_percent"]) for r in got] == [
        (1, 1, None), (1, 1, 22), (1, 2, 30), (2, 1, None), (2, 1, None), (2, 1, 7)]


def micro_batches(df, folder, parts):
    """Write a frame as `parts` files in time order, read as that many micro-batches."""
    rows = df.orderBy(F.monotonically_increasing_id()).collect()
    step = -(-len(rows) // parts)
    for n in range(parts):
        part = df.sparkSession.createDataFrame(rows[n * step:(n + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return open_stream(df.sparkSession, folder, files_per_batch=1)


def test_streams_agree_in_one_and_in_many_batches(spark, tmp_path):
    rows = sorted(random_attempts(120, span=30_000), key=lambda r: r[2])
    labels, _, _ = walk(rows)
    for parts in (1, 4):
        stream = micro_batches(samples(spark, rows), str(tmp_path / f"a{parts}"), parts)
        got = drain(jobs.label_attempts(stream), "append", empty_batches=False).orderBy("event_id").collect()
        assert [(r["event_id"], r["warm"], r["label"]) for r in got] == [(i, w, x) for i, w, _, x in labels]
    first = st.label_attempts(samples(spark, rows).filter("event_id < 70"))
    for parts in (1, 5):
        stream = micro_batches(samples(spark, rows).filter("event_id >= 70"), str(tmp_path / f"b{parts}"), parts)
        got = drain(jobs.label_attempts(stream, jobs.batch_states(first)), "append", empty_batches=False).orderBy("event_id").collect()
        assert [(r["event_id"], r["warm"], r["label"]) for r in got] == [(i, w, x) for i, w, _, x in labels if i >= 70]
    changes = [(0.0, 0, "d"), (0.1, 0.5, "d"), (0.2, 1.0, "d"), (0.6, 1.4, "d"), (0.8, 1.5, "d"), (0.85, 1.6, "complete")]
    stream = micro_batches(updates(spark, changes), str(tmp_path / "p"), 3)
    got = drain(jobs.throttled_progress(stream), "append").orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [0, 2, 4, 5]
    stream = micro_batches(updates(spark, changes), str(tmp_path / "l"), 3)
    last = latest_per_key(drain(jobs.latest_progress(stream), "update"), ["key"]).collect()
    assert [(r["status"], r["active"]) for r in last] == [("complete", False)]


def test_stale_work_times_out(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, 0, at(0), "generating"), (2, 1, at(1), "generating"), (2, 2, at(5), "completed"), (3, 3, at(300), "generating"),
            (4, 4, at(301), "completed")]
    df = spark.createDataFrame(rows, "id bigint, event_id bigint, ts timestamp, status string")
    stream = micro_batches(df, str(tmp_path / "s"), 5)
    done = drain(jobs.stale_work(stream, 3_600_000), "append").cache()
    got = done.filter("status = 'failed'").collect()
    assert [(r["id"], r["error"]) for r in got] == [(1, st.STALE_MESSAGE)]
    every = sorted((i, s) for i, _, _, s in rows)
    assert sorted((r["id"], r["status"]) for r in done.filter("error IS NULL").collect()) == every
    whole = drain(jobs.stale_work(micro_batches(df, str(tmp_path / "one"), 1), 3_600_000), "append")
    assert sorted((r["id"], r["status"]) for r in whole.filter("error IS NULL").collect()) == every


def test_only_new_files_are_read(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(0, 3).write.parquet(folder)
    stream = lambda: jobs.file_increments(open_stream(spark, folder))
    assert drain(stream(), "append", out, check).count() == 3
    spark.range(3, 5).write.mode("append").parquet(folder)
    both = drain(stream(), "append", out, check)
    assert sorted(r["id"] for r in both.filter("batch_id = 1").collect()) == [3, 4] and both.count() == 5


def test_state_older_than_its_time_to_live_goes(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [("s", "q", 60 * i, 50, 3000, True) for i in range(8)]
    warm = {}
    for ttl in (1000, 3_600_000):
        at = f"{folder}{ttl}"
        for part in ("event_id < 4", "event_id >= 4"):
            samples(spark, rows).filter(part).coalesce(1).write.mode("append").parquet(at)
            got = drain(jobs.label_attempts(open_stream(spark, at), ttl_ms=ttl), "append", f"{out}{ttl}", f"{check}{ttl}", empty_batches=False)
            warm[ttl] = [r["warm"] for r in got.orderBy("event_id").collect()]
            time.sleep(2.5)
    assert warm[3_600_000] == [False] * 3 + [True] * 5
    assert warm[1000] == [False] * 3 + [True] + [False] * 3 + [True]


def test_log_metrics_stream(spark, tmp_path):
    lines = ["[QC] Tentative 1/20", "x (meilleur : 22%)", "tentative 2 /20 (Meilleur: 30%)", "Tentative 1/5 (meilleur : —%)",
             "rien", "meilleur : 7", "Tentative 1/9"]
    df = spark.createDataFrame([("q", i, T0 + dt.timedelta(seconds=i), x) for i, x in enumerate(lines)],
                               "queue string, event_id bigint, ts timestamp, line string")
    want = [tuple(r) for r in st.log_metrics(df).select("event_id", "series", "attempt", "best_percent").orderBy("event_id").collect()]
    for parts in (1, 4):
        got = drain(jobs.log_metrics(micro_batches(df, str(tmp_path / str(parts)), parts)), "append", empty_batches=False).orderBy("event_id").collect()
        assert [(r["event_id"], r["series"], r["attempt"], r["best_percent"]) for r in got] == want


class FakeState(dict):
    """What a processor needs of a value or map state."""

    value = None
    get, update = (lambda self: self.value), (lambda self, v: setattr(self, "value", v))
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__


def counted_pieces(columns, rows):
    """Two rows a piece; `taken` tells how many pieces were asked for."""
    taken = []

    def pieces():
        for at in range(0, len(rows), 2):
            taken.append(at)
            yield pd.DataFrame(rows[at:at + 2], columns=columns)

    return pieces(), taken


def streams_by_piece(run, taken, pieces, total):
    assert len(next(run)) == 2 and len(taken) == 1  # the first piece is done before the second is read
    rest = list(run)
    assert len(taken) == pieces and sum(map(len, rest)) + 2 == total


def test_labels_hold_one_piece_of_a_queue():
    rows = [(f"e{i % 2}", "m", i, i * 1000, 10, 900.0, True) for i in range(8)]
    given, taken = counted_pieces(["engine", "model", "event_id", "at_us", "chars", "duration_ms", "ok"], rows)
    job = jobs.AttemptLabels(1000)
    job.speeds, job.success = FakeState(), FakeState()
    streams_by_piece(job.handleInputRows(("q",), given, None), taken, 4, 8)
    assert job.success.value == (7000,) and job.speeds == {("e0", "m"): (40.0, 4), ("e1", "m"): (40.0, 4)}


def test_labels_from_a_state_hold_one_piece_of_a_queue():
    columns = ["engine", "model", "event_id", "at_us", "chars", "duration_ms", "ok", "ms_per_char", "samples", "success_us", "attempt"]
    states = [("e0", "m", 0, 0, 0, 0.0, False, 10.0, 5, 100, False), (None, None, 0, 0, 0, 0.0, False, None, 0, 100, False)]
    rows = [("e0", "m", i, i * 1000, 10, 900.0, True, None, None, None, True) for i in range(6)]
    job = jobs.AttemptLabels(1000, started=True)
    job.speeds, job.success, job.begun = FakeState(), FakeState(), FakeState()
    given, taken = counted_pieces(columns, states + rows)
    run = job.handleInputRows(("q",), given, None)
    first = next(run)
    assert list(first["warm"]) == [True, True] and list(first["samples"]) == [6, 7] and len(taken) == 2
    assert sum(map(len, run)) == 4 and len(taken) == 4 and job.speeds["e0", "m"][1] == 11
    given, _ = counted_pieces(columns, states)  # given again, the queue keeps its own
    assert list(job.handleInputRows(("q",), given, None)) == [] and job.speeds["e0", "m"][1] == 11 and job.success.value == (5000,)


def test_a_stream_given_its_first_state_again_keeps_its_own(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = sorted(random_attempts(90, span=30_000), key=lambda r: r[2])
    labels, _, _ = walk(rows)
    states = jobs.batch_states(st.label_attempts(samples(spark, rows).filter("event_id < 30")))
    for part in ("event_id BETWEEN 30 AND 59", "event_id >= 60"):
        samples(spark, rows).filter(part).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(folder)
        labelled = jobs.label_attempts(open_stream(spark, folder), states, start_folder=str(tmp_path / "start"))
        got = drain(labelled, "append", out, check, empty_batches=False)
    found = [(r["event_id"], r["warm"], r["label"]) for r in got.orderBy("event_id").collect()]
    assert found == [(i, w, x) for i, w, _, x in labels if i >= 30]


def test_log_metrics_hold_one_piece_of_a_queue():
    given, taken = counted_pieces(["event_id", "attempt", "best", "told"], [(i, i % 3 + 1, i, i % 2 == 0) for i in range(6)])
    job = jobs.LogMetrics(1000)
    job.now = FakeState()
    streams_by_piece(job.handleInputRows(("q",), given, None), taken, 3, 6)
    assert job.now.value == (2, 3, 4)


def test_throttling_holds_one_piece_of_a_key():
    class State(FakeState):
        exists = False

    rows = [("k", i, i * 100, float(i // 3), "downloading") for i in range(6)]
    given, taken = counted_pieces(["key", "event_id", "at_ms", "progress", "status"], rows)
    state = State()
    run = jobs._throttle(("k",), given, state)
    assert list(next(run)["event_id"]) == [0] and len(taken) == 1
    assert [i for part in run for i in part["event_id"]] == [3] and state.value == (300, 1.0)


def test_order_holds_when_a_stream_goes_on_with_other_partitions(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    lines = [("q", i, T0 + dt.timedelta(seconds=i), f"Tentative {i % 4 + 1}/4") for i in range(40)]
    df = spark.createDataFrame(lines, "queue string, event_id bigint, ts timestamp, line string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks, part in ((before, "event_id < 20"), ("7", "event_id >= 20")):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            df.filter(part).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(folder)
            got = drain(jobs.log_metrics(open_stream(spark, folder)), "append", out, check, empty_batches=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r["series"], r["attempt"]) for r in got.orderBy("event_id").collect()] == [(i // 4 + 1, i % 4 + 1) for i in range(40)]
