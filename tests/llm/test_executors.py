"""Executors that don't have the package: the functions and models that travel to them carry all they need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's alone: workers start in another folder and without this path
import __spark_entry__
from marlstone.session import local_session
spark = local_session("away", cpus=4, partitions=4, **{{"spark.checkpoint.dir": {shared!r}}})
for name, query in __spark_entry__.queries().items():
    if name == "pipeline" or name.startswith("op") and name[2].isdigit():
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_run_where_the_package_is_not(tmp_path):
    shared = str(tmp_path / "shared")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, shared=shared)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) > 11
    assert not [f for f in os.listdir(shared) if f.startswith("marlstone-")]  # scratch tables go with the driver
