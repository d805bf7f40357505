from __future__ import annotations

import pytest

from helpers import exchanges
from opatlas.operators import findings, gates, requests, scripts
from opatlas.plans import queries
from opatlas.plans.catalogue import script_partials
from opatlas.session import new_shared_path
from opatlas.sources import derived
from opatlas.sources.captures import read_http_exchanges
from opatlas.streaming import stream
from test_findings import rows_of, traffic


def stored_in_files(spark, df, n_files, name):
    path = new_shared_path(spark, name)
    df.repartition(n_files, "capture_id").write.parquet(path)
    return path


def items_of(spark, path):
    source = read_http_exchanges(spark, path, stream=True)
    return requests.http_items(source)


def exchanges_of(spark, path):
    return requests.http_exchange_items(read_http_exchanges(spark, path, stream=True))


def batch_of(df):
    return findings.merge(findings.findings_of_exchanges(requests.http_exchange_items(df)))


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_streamed_operations_equal_the_batch(spark):
    df = traffic(spark)
    path, out = stored_in_files(spark, df, 4, "in"), new_shared_path(spark, "out")
    run(stream.write_ops(items_of(spark, path), f"{out}/t", f"{out}/c"))
    columns = ["capture_id", "ord", "operation_type", "operation_name", "operation_body"]
    assert rows_of(spark.read.parquet(f"{out}/t"), columns) == rows_of(requests.http_ops(df), columns)


def test_a_key_is_reported_once_for_ever(spark):
    df = traffic(spark)
    path, out = stored_in_files(spark, df, 3, "in"), new_shared_path(spark, "out")
    run(stream.write_first_sight(items_of(spark, path), f"{out}/t", f"{out}/c"))
    # The same captures arrive again, and one new one with them.
    df.write.mode("append").parquet(path)
    exchanges(spark, [{"body": '{"query":"query Late { a }"}'}]).write.mode("append").parquet(path)
    run(stream.write_first_sight(items_of(spark, path), f"{out}/t", f"{out}/c"))
    batch = batch_of(df)
    got = rows_of(spark.read.parquet(f"{out}/t"), findings.KEY)
    assert got == sorted([*rows_of(batch, findings.KEY), ("/graphql", "Late", "query", "")])


def test_merged_stream_equals_the_batch_over_several_runs(spark):
    first, second = traffic(spark, seed=1), traffic(spark, seed=2)
    second = second.selectExpr("capture_id + 1000 AS capture_id", "ts + interval 1 day AS ts", *second.columns[2:])
    path, out = stored_in_files(spark, first, 3, "in"), new_shared_path(spark, "out")
    run(stream.write_partials(exchanges_of(spark, path), findings.findings_of_exchanges, f"{out}/t", f"{out}/c"))
    second.write.mode("append").parquet(path)
    run(stream.write_partials(exchanges_of(spark, path), findings.findings_of_exchanges, f"{out}/t", f"{out}/c"))
    batch = batch_of(first.unionByName(second))
    assert rows_of(stream.merged(spark, f"{out}/t")) == rows_of(batch)
    # A broken attempt leaves a folder that nobody published; a batch that runs again is counted once.
    batch.write.parquet(f"{out}/t/partials/broken")
    attempts, _ = stream._published(spark, f"{out}/t")
    again = [a.rsplit("/", 1)[1] for a in attempts]
    commits = {r.attempt: r.batch_id for r in spark.read.parquet(f"{out}/t/commits").collect()}
    stream._publish(spark, f"{out}/t", {"requests": commits[again[0]]}, again[0])
    assert rows_of(stream.merged(spark, f"{out}/t")) == rows_of(batch)
    assert rows_of(stream.compact(spark, f"{out}/t")) == rows_of(batch)
    assert len(stream._published(spark, f"{out}/t")[0]) == 1
    third = second.selectExpr("capture_id + 1000 AS capture_id", *second.columns[1:])
    third.write.mode("append").parquet(path)
    run(stream.write_partials(exchanges_of(spark, path), findings.findings_of_exchanges, f"{out}/t", f"{out}/c"))
    assert rows_of(stream.merged(spark, f"{out}/t")) == rows_of(batch_of(first.unionByName(second).unionByName(third)))


def test_a_compaction_killed_at_any_step_leaves_the_counts_right(spark, monkeypatch):
    """Two streams publish to one path; whatever step is lost, no run is counted twice or not at all."""
    path, out = new_shared_path(spark, "in"), f"{new_shared_path(spark, 'out')}/t"
    body = {"body": '{"query":"query Twice { a }"}'}
    exchanges(spark, [body, body]).write.parquet(path)

    def drain(name):
        df = exchanges_of(spark, path)
        run(stream.write_partials(df, findings.findings_of_exchanges, out, f"{out}-{name}", name=name))

    def n_seen():
        return [r.n_seen for r in stream.merged(spark, out).collect()]

    drain("one")
    drain("two")
    assert n_seen() == [4]
    files = len(spark.read.parquet(f"{out}/commits").inputFiles())

    class Killed(Exception):
        pass

    def killed(*_, **__):
        raise Killed

    for step, owner in (("_publish", stream), ("_published", stream), ("merge", findings)):
        with monkeypatch.context() as patch:
            patch.setattr(owner, step, killed)
            with pytest.raises(Killed):
                stream.compact(spark, out)
        assert n_seen() == [4]
    # the switch itself is one file for both streams
    assert [r.n_seen for r in stream.compact(spark, out).collect()] == [4]
    assert len(spark.read.parquet(f"{out}/commits").inputFiles()) == files + 1
    exchanges(spark, [body]).write.mode("append").parquet(path)
    drain("two")
    assert n_seen() == [5]
    drain("one")
    assert n_seen() == [6]
    # an older batch that runs again stands in the snapshot already
    stream._publish(spark, out, {"one": 0}, stream._published(spark, out)[0][0].rsplit("/", 1)[1])
    assert n_seen() == [6]
    assert [r.n_seen for r in stream.compact(spark, out).collect()] == [6]


def test_each_script_text_is_read_once_for_all_batches(spark):
    texts = ["gql`query A { a }`;", "gql`query B { b }`; query C { c }", "query none"]
    rows = [
        {"method": "GET", "path": f"/{i % 4}.js", "content_type": "text/javascript", "script": texts[i % 3]} for i in range(1200)
    ]
    df = exchanges(spark, rows)
    path, out = stored_in_files(spark, df, 5, "in"), new_shared_path(spark, "out")

    def arriving():
        schema = spark.read.parquet(path).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    run(stream.write_script_partials(arriving(), f"{out}/t", f"{out}/c"))
    n_ops = scripts.bundle_ops(scripts.distinct_bundles(gates.script_captures(df))).count()
    known = spark.read.parquet(f"{out}/t/bundles")
    assert known.where("operation_type is null").count() == 3  # each text once, though 400 came in five batches
    assert known.where("operation_type is not null").count() == n_ops
    batch = findings.merge(script_partials(df))
    assert rows_of(stream.merged(spark, f"{out}/t")) == rows_of(batch)
    assert len(stream._published(spark, f"{out}/t")[0]) == 5
    run(stream.write_script_ops(arriving(), f"{out}/o", f"{out}/oc"))
    found = stream.published(spark, f"{out}/o")
    assert found.count() == 400 * n_ops
    assert spark.read.parquet(f"{out}/o/bundles").count() == 3 + n_ops


def test_a_stream_reads_a_table_in_one_file_and_one_in_a_folder_of_files(spark, tmp_path):
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    columns = {"events": "event_id", "pages": "page_id", "conversations": "conv_id"}
    for name, key in columns.items():
        table = derived.read_table(spark, "/root/testdata/sf0.001", name)
        table.repartition(7, key).write.parquet(f"{many}/{name}.parquet")
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / "one").mkdir(exist_ok=True)
        next((tmp_path / name).glob("part-*.parquet")).rename(f"{one}/{name}.parquet")
        for folder in (one, many):
            out = f"{tmp_path}/out-{name}-{folder[-4:]}"
            stream_of = derived.read_table(spark, folder, name, stream=True).select(key)
            run(stream_of.writeStream.option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(out, format="parquet"))
            assert rows_of(spark.read.parquet(out), [key]) == rows_of(table, [key])
            # however many files, no more than two micro-batches
            assert len(list((tmp_path / f"out-{name}-{folder[-4:]}-c" / "commits").glob("[0-9]*"))) <= 2
    keys = queries.stream_first_seen(spark, many)
    assert rows_of(keys, findings.KEY) == rows_of(queries.all_findings(spark, many), findings.KEY)


def test_arriving_files_are_spread_over_tasks_whatever_the_micro_batches(spark, tmp_path):
    arriving = queries._arriving(spark, "/root/testdata/sf0.001", "api", n_batches=2)
    ids = arriving.select("capture_id", "_metadata.file_path")
    out = f"{tmp_path}/out"
    run(ids.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(out, format="parquet"))
    written = spark.read.parquet(out)
    assert written.select("file_path").distinct().count() == 4  # the session's shuffle partitions
    assert written.count() == derived.captures(spark, "/root/testdata/sf0.001", "api").count()
    assert len(list((tmp_path / "c" / "commits").glob("[0-9]*"))) == 2
