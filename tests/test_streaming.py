from patchlens.operators.profile import assemble_commits
from patchlens.plans.commits import clean_commits
from patchlens.session import scratch_path
from patchlens.sources.fixtures import commit_files
from patchlens.streaming.commit_stream import stream_clean_commits

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    raw = assemble_commits(commit_files(spark, SF))
    src = scratch_path(spark, "stream-src")
    raw.repartition(4).write.parquet(src)
    sink = scratch_path(spark, "stream-sink")
    q = stream_clean_commits(spark, src, sink, max_files=1)
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r) for r in clean_commits(raw).collect())
    assert got == want
