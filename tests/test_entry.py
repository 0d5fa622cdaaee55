"""The entry works with and without the optional packages."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("absent", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_optional_packages(tmp_path, absent):
    """A tree of links that leaves out the absent parts."""
    (tmp_path / "jobtrail").mkdir()
    for folder in ("", "jobtrail"):
        for name in os.listdir(os.path.join(ROOT, folder)):
            if name not in (*absent, "jobtrail", ".git", "__pycache__"):
                os.symlink(os.path.join(ROOT, folder, name), tmp_path / folder / name)
    # A linked script would be found by its target's folder.
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (tmp_path / name).exists():
            (tmp_path / name).unlink()
            (tmp_path / name).write_text(open(os.path.join(ROOT, name)).read())
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env=environment, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    queries, oracles, text_queries = map(int, out.stdout.split())
    assert queries > 90 and oracles > 80
    assert (text_queries == 0) == ("llm" in absent)
