import subprocess
import sys
import textwrap

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_folder():
    code = """
    import sys
    sys.modules["tessera.llm"] = None
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert "bm25_recall" in names and not [n for n in names if n == "pipeline" or n.startswith("op")]
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
