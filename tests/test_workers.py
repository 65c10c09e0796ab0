"""Python workers need neither this package nor its folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys; sys.path.insert(0, {root!r})
from memlake import registry
from memlake.session import local_session
spark = local_session(cpus="2", memory="2g")
for name in ("corpus_chunk", "vector_topk", "stream_perf", "plug_embedder"):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("done")
"""


def test_udfs_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]


def test_names_are_found_in_short_arrow_batches(spark):
    """Texts reach the automaton a thousand at a time, and found names leave it in rows of bounded number."""
    from memlake.operators import roles
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    names = [f"näme {i:03d}é" for i in range(300)]
    texts = spark.range(400).selectExpr("cast(id as string) as query_id", "concat_ws(' ', transform(sequence(0, 299), i -> concat('näme ', lpad(i, 3, '0'), 'é'))) as text")
    found = roles._by_automaton(texts.coalesce(1), names)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert found.distinct().count() == found.count() == 400 * 300
    assert {r.name for r in found.filter("query_id = '399'").collect()} == set(names)
    assert roles._by_automaton(texts, []).isEmpty()
