import json

from rankloom.streaming import run_facts
from tests.test_facts import FACT


def test_files_become_runs_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "runs")
    (src / "smoke").mkdir(parents=True)
    for name, body in (("a.json", json.dumps(FACT)), ("b.json", "{"), ("smoke/c.json", json.dumps(FACT)), ("a.rankings.json", json.dumps(FACT))):
        (src / name).write_text(body)

    def run():
        run_facts.append_runs(run_facts.arriving_files(spark, str(src)), out, str(tmp_path / "cp")).awaitTermination(60)
        return spark.read.parquet(out).count()

    assert run() == 1 and run() == 1
    (src / "d.json").write_text(json.dumps({**FACT, "status": "failed"}))
    assert run() == 2
