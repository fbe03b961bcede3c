"""The entry works without a session, a JVM or readable jars."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

PROGRAM = """
import pathlib, shutil, subprocess
def refuse(*args, **kwargs):
    raise AssertionError("no process may start and no folder may be searched")
subprocess.Popen = refuse
pathlib.Path.glob = refuse
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(len(entry.queries()))
"""


def test_import_needs_no_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME", "JAVA_HOME")} | {"PATH": "/nowhere", "PYTHONPATH": str(REPO)}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 68
