import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_subpackage(tmp_path):
    """The rest imports and lists its queries when the training-data folder and the pipeline are gone."""
    for name in ("semindex", "__spark_entry__.py"):
        source = os.path.join(HERE, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and not any(n.startswith('op') for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 20


def test_nothing_outside_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(HERE, "semindex")):
        if f"{os.sep}llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    assert "semindex.llm" not in open(os.path.join(folder, name)).read(), name
