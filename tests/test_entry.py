"""The driver contract: names, imports without a session, and the guard around the llm folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout


def test_entry_imports_without_a_session():
    assert int(run("import __spark_entry__ as e; print(len(e.queries()))")) > 80


def test_oracles_belong_to_queries():
    assert run("import __spark_entry__ as e; print(set(e.oracle_sql()) - set(e.queries()))").strip() == "set()"


def test_entry_works_without_the_llm_folder():
    code = "import sys\nclass Gone:\n def find_spec(self, name, *a):\n  if name.startswith(('chunkwright.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name=name)\n"
    code += "import importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith(('chunkwright.llm', 'corpus_pipeline')) else real(n, *a)\nsys.meta_path.insert(0, Gone())\n"
    code += "import __spark_entry__ as e; print(any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    assert run(code).strip() == "False"


def test_nothing_outside_imports_the_llm_folder():
    for path in (ROOT / "chunkwright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "chunkwright.llm" not in path.read_text()
