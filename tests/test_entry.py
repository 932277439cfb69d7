"""The telemetry queries stand alone: without the training-data folders the entry imports and keeps them."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n == 'pipeline' or n[:2] == 'op' for n in q), set(s) <= set(q))"


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{ROOT}/telemill", tmp_path / "telemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, sql, training, paired = out.stdout.split()
    assert int(n) > 70 and int(sql) > 60 and (training, paired) == ("False", "True")
