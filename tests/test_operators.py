"""Scenarios of the survey and small simulators, held against the operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import placement as P
from tidemark.functions import strings as X
from tidemark.operators import analysis as A
from tidemark.operators import exchange, kv, locks, ordering, stats, store, tpcc, workload
from tidemark.plans import registry
from tidemark.sources import datums
from tidemark.sources import tpcc as tables
from tidemark.sources.requests import Configuration
from tidemark.streaming import logs as ST

from .conftest import SMALL


def test_placement_of_the_known_keys(spark):
    keys = spark.createDataFrame([(k,) for k in "ABCDEFXYZ"], "key string")
    two = {r.key: r.p for r in keys.select("key", P.hash_partition("key", 2, 1).alias("p")).collect()}
    assert [two[k] for k in "ACBX"] == [0, 0, 1, 1]
    three = {r.key: r.p for r in keys.select("key", P.hash_partition("key", 3, 1).alias("p")).collect()}
    assert [three[k] for k in "ADYCFXBEZ"] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_fnv_of_an_empty_key_is_the_offset(spark):
    assert spark.range(1).select(P.fnv1(F.lit("")).alias("h")).first().h == P.FNV_OFFSET


def access(spark, rows):
    return spark.createDataFrame(rows, "txn_id long, key string, part long, master long, is_write boolean")


def test_types_of_transactions(spark):
    rows = [(1, "A", 0, 0, False), (1, "B", 1, 0, True), (2, "A", 0, 0, False), (2, "C", 0, 1, True), (3, "Q", 0, None, False)]
    found = {r.txn_id: (r.type, r.home, r.active_partitions) for r in A.classify(access(spark, rows)).collect()}
    assert found == {1: (A.SINGLE, 0, "1"), 2: (A.MULTI, -1, "0"), 3: (A.UNKNOWN, -1, "")}


def test_lock_only_projection_drops_the_partition_without_own_keys(spark):
    rows = access(spark, [(1, "A", 0, 1, False), (1, "C", 0, 1, False), (1, "B", 1, 0, True), (1, "D", 1, 1, True)])
    parts = A.lock_only(rows, A.classify(rows)).where("home = 0")
    found = {(r.part, r.n_keys, r.redundant) for r in A.project(rows, parts).collect()}
    assert found == {(0, 2, True), (1, 2, False)}


KEYS = [(1, "A", True), (1, "B", True), (1, "C", True)]


def run_kv(spark, commands, keys=None):
    acc = spark.createDataFrame([(1, i, w) for i, (_, _, w) in enumerate(KEYS)] if keys is None else keys, "txn_id long, key long, is_write boolean")
    st = spark.createDataFrame([(0, "valueA"), (1, "valueB"), (2, "valueC")], "key long, value string")
    proc = spark.createDataFrame([(1, i, *c) for i, c in enumerate(commands)], "txn_id long, seq int, command string, a long, b string")
    return proc, acc, st


def test_copies_read_pre_images_and_so_swap(spark):
    done = {r.key: r.new_value for r in kv.effects(*run_kv(spark, [("COPY", 2, "1"), ("COPY", 1, "2")])).collect()}
    assert done == {1: "valueC", 2: "valueB"}


def test_a_false_comparison_aborts_and_drops_all_writes(spark):
    proc, acc, st = run_kv(spark, [("SET", 1, "new"), ("EQ", 0, "notA")])
    assert kv.execute(proc, acc, st).first().status == "ABORTED"
    assert kv.committed_writes(acc, kv.effects(proc, acc, st), kv.aborts(proc, acc, st)).count() == 0


def test_last_command_on_a_key_wins_and_unset_writes_are_blank(spark):
    proc, acc, st = run_kv(spark, [("SET", 0, "x"), ("SET", 0, "y"), ("DEL", 1, None), ("FLY", 2, None)])
    done = {r.key: (r.value, r.deleted) for r in kv.committed_writes(acc, kv.effects(proc, acc, st), kv.aborts(proc, acc, st)).collect()}
    assert done == {0: ("y", False), 1: (None, True), 2: ("", False)}


def test_writes_to_undeclared_keys_do_nothing(spark):
    proc, acc, st = run_kv(spark, [("SET", 0, "x"), ("SET", 1, "y")], [(1, 0, False)])
    assert kv.effects(proc, acc, st).count() == 0


def test_wait_edges_equal_a_sequential_lock_table(spark):
    rng = random.Random(4)
    seen, requests = set(), []
    for pos in range(150):
        for name in rng.sample("abcdefgh", rng.randint(1, 3)):
            if (pos, name) not in seen:
                seen.add((pos, name))
                requests.append((pos, pos, name, rng.random() < 0.4))
    expected, last_write, reads = set(), {}, {}
    for pos, _, name, w in requests:
        if w:
            for r in reads.get(name, []) or ([last_write[name]] if name in last_write else []):
                expected.add((r, pos))
            last_write[name], reads[name] = pos, []
        else:
            if name in last_write:
                expected.add((last_write[name], pos))
            reads.setdefault(name, []).append(pos)
    df = spark.createDataFrame(requests, "pos long, txn_id long, name string, is_write boolean")
    edges = locks.wait_edges(df)
    assert {(r.blocker, r.waiter) for r in edges.collect()} == expected
    level = {}
    for b, w in sorted(expected, key=lambda e: e[1]):
        level[w] = max(level.get(w, 0), level.get(b, 0) + 1)
        level.setdefault(b, 0)
    assert {r.node: r.level for r in locks.levels(edges).collect()} == level


def test_levels_of_the_log_follow_waits_across_batches(spark, tmp_path):
    writes = [(i, 1, "R") for i in (0, 39, 40, 41, 80, 200)] + [(i, 2, "N") for i in (5, 81)] + [(300, 2, "R")]
    spark.createDataFrame(writes, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.node: r.level for r in registry.QUERIES["exec_level_log"](spark, str(tmp_path)).collect()}
    assert found == {0: 0, 39: 1, 40: 2, 41: 3, 80: 4, 200: 5, 5: 0, 81: 0, 300: 1}


def test_a_waiting_head_blocks_its_whole_home(spark, tmp_path):
    # keys 1 to 3 are of home 0, key 4 of home 1; key 2 waits
    spark.createDataFrame([(5, 1, "N"), (5, 2, "N"), (6, 3, "N"), (7, 4, "N"), (100, 1, "N"), (950, 1, "R")], "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r.txn_id, r.key): (r.verdict, r.blocked) for r in registry.QUERIES["remaster_hol_home"](spark, str(tmp_path)).collect()}
    assert found[5, 2][0] == "WAIT" and {k for k, v in found.items() if v[1]} == {(6, 3), (100, 1), (950, 1)}


def test_a_circle_of_waits_is_refused(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "blocker long, waiter long")
    with pytest.raises(ValueError):
        locks.levels(edges, 5)


@pytest.mark.parametrize("start", [1, 10, 91, 92, 100])
def test_stock_depends_on_the_sum_alone(spark, start):
    rng, q, ordered = random.Random(start), start, 0
    rows = []
    for _ in range(60):
        n = rng.randint(1, 50)
        q, ordered = (q - n if q > n else q - n + 91), ordered + n
        rows.append((ordered, q))
    df = spark.createDataFrame(rows, "ordered long, q long")
    assert df.where(tpcc.stock_after(F.lit(start), F.col("ordered")) != F.col("q")).count() == 0


def test_prefix_stops_at_the_first_gap(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1), (3, 0), (3, 0), (3, 1)], "q long, p long")
    assert sorted((r.q, r.p) for r in ordering.prefix(df, ["q"], "p").collect()) == [(1, 0), (1, 1), (3, 0), (3, 0), (3, 1)]


def test_floor_percentiles_of_seven(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 8)], "g string, v long")
    found = {r.percent: r.v for r in stats.floor_percentiles(df, ["g"], "v").collect()}
    assert found[90] == 6 and found[0] == 1 and found[100] == 7


def test_strings(spark):
    t = spark.createDataFrame([("hello world, c++", "  \t x \n")], "a string, b string")
    r = t.select(X.tokens("a", " ,").alias("t"), X.next_n_tokens("a", 4, " ,").alias("four"), X.next_n_tokens("a", 2, " ,").alias("two"), X.trim_space("b").alias("b"), X.next_token(F.lit(""), " ").alias("none")).first()
    assert (r.t, r.four, r.two, r.b, r.none) == (["hello", "world", "c++"], [], ["hello", "world"], "x", "")


def test_empty_tables(spark):
    none = access(spark, [])
    assert A.classify(none).count() == 0
    assert locks.wait_edges(spark.createDataFrame([], "pos long, txn_id long, name string, is_write boolean")).count() == 0
    versions = spark.createDataFrame([], "key long, value string, deleted boolean, p int")
    st = spark.createDataFrame([(1, "a")], "key long, value string")
    assert [tuple(r) for r in store.apply_versions(st, store.last_versions(versions, F.col("p"))).collect()] == [(1, "a", True)]


def test_datums_round_trip_and_refuse_what_is_out_of_place(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    data = datums.generate(spark, 500, 100, 3, 4)
    assert datums.write(data, folder) == 4
    found = datums.read(spark, folder).withColumn("part", F.regexp_extract("file", r"(\d+)", 1).cast("long"))
    part = P.hash_partition(F.col("key").cast("string"), 4)
    assert found.count() == 500 and datums.invalid(found, part, 3).count() == 0
    assert datums.load(found, part, 3).select("key", "value").exceptAll(data.select(F.col("key").cast("string"), F.col("record").cast("string"))).count() == 0
    with pytest.raises(Exception, match="datum out of place"):
        datums.load(found, part, 2).collect()


def test_configuration_is_checked():
    assert Configuration.of({"regions": 2, "partitions": 3, "replication_order": {0: [1], 1: [0]}}).batch_us == 1000
    for bad in ({"regions": 0, "partitions": 1}, {"regions": 2, "partitions": 1, "replication_factor": 3}, {"regions": 2, "partitions": 1, "replication_order": {0: [0]}}, {"regions": 1, "partitions": 1, "what": 1}):
        with pytest.raises(ValueError):
            Configuration.of(bad)


def test_basic_workload_has_different_keys_of_the_right_lists(spark):
    rows = workload.basic(spark, 300, 1000, 4, 3, mh=50, mp=50, records=10, writes=4)
    assert rows.groupBy("txn_id").agg(F.count_distinct("key").alias("n")).where("n <> 10").count() == 0
    assert rows.where((P.simple_partition("key", 4) != F.col("part")) | (P.simple_home("key", 4, 3) != F.col("home"))).count() == 0
    with pytest.raises(ValueError):
        workload.basic(spark, 1, 10, 1, 1, speed=3)


def test_zipf_ranks_are_in_range_and_fall(spark):
    n = spark.range(20000).select(workload.zipf_inverse(workload.draw(F.col("id"), 1, 1 << 24) / (1 << 24), 100, 0.9).alias("k")).groupBy("k").count().collect()
    by = {r.k: r["count"] for r in n}
    assert min(by) == 0 and max(by) < 100 and by[0] > by[1] > by.get(20, 0)


def test_orders_of_a_district_are_of_different_customers(spark):
    o = tables.order(spark, 1)
    assert o.groupBy("d_id").agg(F.count_distinct("c_id").alias("n")).where("n <> 3000").count() == 0


def test_json_transactions_of_one_file_each(spark, tmp_path):
    from tidemark.sources import requests

    (tmp_path / "copy.json").write_text('{\n "read_set": ["A"],\n "write_set": ["C"],\n "code": [["COPY", "A", "C"], []]\n}')
    (tmp_path / "move.json").write_text('{"write_set": ["A"], "new_master": 1}')
    txns = requests.json_txns(spark, str(tmp_path))
    assert {(r.file, r.place, r.key, r.is_write) for r in requests.accesses(txns).collect()} == {("copy.json", 0, "C", True), ("copy.json", 1, "A", False), ("move.json", 0, "A", True)}
    assert {(r.command, r.a, r.b) for r in requests.procedures(txns).collect()} == {("COPY", "A", "C"), (None, None, None)}
    assert {(r.file, r.new_master) for r in txns.select("file", "new_master").collect()} == {("copy.json", None), ("move.json", 1)}


def test_first_error_of_a_new_order_is_kept(spark):
    orders = spark.createDataFrame([(1, True, True, True), (2, False, False, True), (3, True, True, False), (4, True, True, True), (5, True, True, True)], "order_id long, has_warehouse boolean, has_customer boolean, has_district boolean")
    lines = spark.createDataFrame([(1, 1, True, True), (2, 1, False, True), (4, 2, False, True), (4, 1, True, False), (5, 1, False, False)], "order_id long, number int, has_item boolean, has_stock boolean")
    found = {r.order_id: r.abort_reason for r in tpcc.first_error(orders, lines).collect()}
    assert found == {
        1: "", 2: "NewOrder Txn - Warehouse does not exist", 3: "NewOrder Txn - The district does not exist", 4: "NewOrder Txn - Stock of the item does not exist", 5: "NewOrder Txn - The item does not exist",
    }


def test_dispatch_of_odd_calls(spark):
    rows = [(1, None), (2, []), (3, [[]]), (4, [None]), (5, [[None]]), (6, [["payment"] + ["1"] * 8]), (7, [["payment"]]), (8, [["deliver"] + ["1"] * 6, ["more"]]), (9, [["new_order"] + ["1"] * 6])]
    calls = spark.createDataFrame(rows, "id int, calls array<array<string>>")
    found = {r.id: r.why for r in calls.select("id", tpcc.dispatched(F.col("calls")).alias("why")).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == ["Invalid code"] * 4
    assert found[5] == "Unknown procedure name"
    assert found[6] == found[8] == ""
    assert found[7] == "Payment Txn - Invalid number of arguments"
    assert found[9] == "NewOrder Txn - Invalid number of arguments"


def test_slots_stop_at_the_first_that_is_not_ready(spark):
    slots = spark.createDataFrame([(0, 5), (1, 6), (3, 8)], "slot long, batch_id long")
    data = lambda *ids: spark.createDataFrame([(i,) for i in ids], "batch_id long")
    found = lambda *ids: sorted(r.slot for r in exchange.slot_prefix(slots, data(*ids)).collect())
    assert found(5, 6, 8) == [0, 1]
    assert found(5, 8) == [0]
    assert found(6, 8) == found() == []


def test_a_waiter_is_ready_once_all_that_it_waits_for_is_gone(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (3, 5)], "blocker long, waiter long")
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node long")
    assert sorted(r.node for r in exchange.released(edges, gone(1)).collect()) == [4]
    assert sorted(r.node for r in exchange.released(edges, gone(1, 2)).collect()) == [3, 4]
    assert exchange.released(edges, gone()).count() == 0


def test_merged_events_keep_the_main_part_and_what_differs(spark):
    rows = [(1, 0, 0, "A", 1, 1), (1, 0, 1, "B", 2, 1), (1, 2, 0, "A", 1, 1), (1, 2, 1, "B", 3, 1), (1, 2, 2, "C", 4, 1), (2, 1, 0, "A", 1, 1)]
    events = spark.createDataFrame(rows, "txn_id long, home long, idx int, event string, time long, machine long")
    found = sorted((r.txn_id, r.home, r.idx) for r in exchange.merged_events(events).collect())
    assert found == [(1, 0, 0), (1, 0, 1), (1, 2, 1), (1, 2, 2), (2, 1, 0)]


def test_samples_are_exact_however_numbers_tie(spark):
    rows = spark.range(3000).withColumn("lot", F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 1_000_003) % (1 << 31)))
    wanted = sorted((r.lot, r.id) for r in rows.collect())
    for size in (0, 1, 500, 1200, 2999, 3000, 9000):
        assert sorted((r.lot, r.id) for r in stats.exact_sample(rows, F.col("lot"), ["id"], size).collect()) == wanted[:size]
    assert [stats.sample_size(n, 10, 500) for n in (0, 300, 4000, 9000)] == [0, 300, 500, 900]


def test_hot_records_come_from_hot_keys_and_are_distinct(spark):
    keys = workload.basic(spark, 400, 200, 2, 2, mp=50, mh=50, records=6, writes=3, hot=8, hot_records=4).collect()
    by_txn = {}
    for r in keys:
        by_txn.setdefault(r.txn_id, []).append(r.key)
    for found in by_txn.values():
        assert len(set(found)) == 6
        assert sum(k // 4 < 4 for k in found) == 4
    with pytest.raises(ValueError):
        workload.basic(spark, 1, 200, 2, 2, records=6, writes=3, hot=4, hot_records=4)


def test_throughput_is_rounded_and_infinite_without_time(spark):
    rows = spark.createDataFrame([(100, 0), (100, 3), (1, 2000), (2, 3000)], "n long, ms long")
    assert [r[0] for r in rows.select(stats.throughput_text(F.col("n"), F.col("ms"))).collect()] == ["inf", "33333.333", "0.500", "0.667"]


def test_levels_settle_across_blocks(spark):
    """A chain through all blocks beside random waits, against a walk in order; far more levels than rounds are allowed."""
    rng = random.Random(7)
    edges = {(i, i + 1) for i in range(3, 300)} | {(b, b + rng.randint(1, 200)) for b in rng.choices(range(900), k=700)}
    level = {}
    for b, w in sorted(edges, key=lambda e: e[1]):
        level[w] = max(level.get(w, 0), level.setdefault(b, 0) + 1)
    df = spark.createDataFrame(sorted(edges), "blocker long, waiter long")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    for block_edges, at_once in ((100, 4), (350, 2), (5000, 4)):
        assert {r.node: r.level for r in locks.levels(df, block_edges=block_edges, at_once=at_once).collect()} == level
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - jobs < max(level.values())
    with pytest.raises(ValueError):
        locks.levels(df, most=max(level.values()), block_edges=100)
    assert locks.levels(df, most=max(level.values()) + 1).count() == len(level)


def test_the_first_gap_is_found_across_blocks(spark):
    gaps = {1: {70}, 2: {64}, 3: set(), 4: {0}, 5: {128, 129}, 6: set(range(64, 128))}
    rows = spark.createDataFrame([(q, p) for q, lost in gaps.items() for p in range(200) if p not in lost], "q long, position long").withColumn("following", F.lit(0).cast("long"))
    wanted = {1: 70, 2: 64, 3: 200, 4: 0, 5: 128, 6: 64}
    assert {r.q: r.end for r in ordering.prefix_ends(rows, ["q"], 64).collect()} == wanted
    later = rows.where("position >= 130").withColumn("following", F.lit(130).cast("long"))
    assert {r.end for r in ordering.prefix_ends(later, ["q"], 64).collect()} == {200}


def test_resequencing_holds_what_is_early_and_drops_repeats_without_python_groups(spark, tmp_path):
    waves = [[(1, 1, "b"), (1, 3, "d"), (2, 0, "x"), (2, 0, "x")], [(1, 0, "a"), (2, 0, "late"), (1, 5, "f")], [(1, 2, "c"), (1, 3, "again"), (2, 1, "y")]]
    rows = spark.createDataFrame([(*r, w) for w, wave in enumerate(waves) for r in wave], "queue long, position long, value string, wave int")
    stream, arrive = ST.staged(spark, rows, str(tmp_path / "in"), "wave")
    found = ST.run(stream, str(tmp_path / "out"), 3, [arrive], ST.resequence)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "x"), (2, 1, "y")]
    assert sorted(r.position for r in spark.read.parquet(str(tmp_path / "out/out/batch=0")).collect()) == [0]


def in_turn(times, duration, most):
    """Batches one event after the other; times of one machine."""
    start, place, out = None, 0, []
    for i, t in sorted(enumerate(times), key=lambda e: (e[1], e[0])):
        if start is None or t >= start + duration:
            start, place = t, 0
        out.append((i, t, start, place // most, place % most))
        place += 1
    return out


def test_batches_without_a_gap_are_no_one_group(spark):
    """What Python gets at once is a segment's times, and what is followed on is a row for each different end."""
    rng = random.Random(3)
    machines = {0: [rng.randrange(-3000, 9000) for _ in range(700)], 1: [rng.randrange(0, 40_000) for _ in range(400)], 2: list(range(0, 5000, 9)), 3: [i * 100 for i in range(90)], 4: [77] * 50, 5: [0, 99, 100, 5000]}
    rows = spark.createDataFrame([(m, i, t) for m, ts in machines.items() for i, t in enumerate(ts)], "machine long, id long, t long")
    wanted = sorted((m, *r) for m, ts in machines.items() for r in in_turn(ts, 100, 7))
    assert len(ordering._steps(pd.DataFrame({"machine": 0, "segment": 0, "t": sorted(set(machines[0]))}), 100)) < 100
    assert sorted(tuple(r) for r in ordering.anchored_batches(rows, 100, 7).collect()) == wanted


def test_a_stream_goes_on_with_the_open_batch(spark, tmp_path):
    rng = random.Random(5)
    machines = {0: sorted(rng.randrange(0, 6000) for _ in range(300)), 1: sorted(rng.randrange(0, 60_000) for _ in range(80)), 2: [10] * 20 + [1990] * 20 + [2010] * 20}
    cuts = lambda t: 0 if t < 2000 else 1 if t < 2050 else 2  # noqa: E731  (the second wave lies within a segment, and mostly within open batches)
    rows = spark.createDataFrame([(m, i, t, cuts(t)) for m, ts in machines.items() for i, t in enumerate(ts)], "machine long, id long, t long, wave int")
    stream, arrive = ST.staged(spark, rows, str(tmp_path / "in"), "wave")
    found = ST.run(stream, str(tmp_path / "out"), 3, [arrive], lambda s, f: ST.anchored_batches(s, f, 100, 7))
    assert sorted(tuple(r) for r in found.collect()) == sorted((m, *r) for m, ts in machines.items() for r in in_turn(ts, 100, 7))


def test_sub_transactions_are_those_of_the_projection(spark):
    rng = random.Random(2)
    rows = access(spark, [(t, str(k), rng.randrange(3), rng.choice([0, 1, 2] + [None] * (t % 7 == 0)), rng.random() < 0.5) for t in range(40) for k in range(rng.randint(1, 6))])
    wanted = A.project(rows, A.lock_only(rows, A.classify(rows)))
    found = A.sub_transactions(rows)
    assert found.dtypes == wanted.dtypes and wanted.count() > 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_surplus_counts_repeats(spark):
    one, two = (spark.createDataFrame(r, "a long, b string") for r in ([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], [(1, "x"), (2, None), (4, "w")]))
    assert A.surplus(one, two).first().n_differing == one.exceptAll(two).count() == 3
    assert A.surplus(one, one).first().n_differing == 0


@pytest.mark.parametrize("name", ["txn_equality", "partition_projection", "redundant_subtxn", "merge_events"])
def test_tasks_grow_in_number_with_the_table(spark, monkeypatch, name):
    from tidemark.plans import catalog

    monkeypatch.setattr(catalog, "TASK_ROWS", 300)
    parts = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 300)
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert f", {parts})" in plan and ", 4), ENSURE" not in plan.replace("hashpartitioning(key", "")
