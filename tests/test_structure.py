"""Rules about the package itself."""

import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent
OWN = [p for p in (ROOT / "lattica").rglob("*.py") if "llm" not in p.parts]


def test_nothing_outside_imports_the_optional_subpackage():
    for p in OWN:
        text = p.read_text()
        assert "lattica.llm" not in text and "from .llm" not in text and "from . import llm" not in text, p


def test_lineage_is_cut_in_shared_folders_only():
    for p in (ROOT / "lattica").rglob("*.py"):
        assert ".localCheckpoint(" not in p.read_text(), p


def test_arrays_are_never_unpickled():
    for p in OWN:
        text = p.read_text()
        assert "pickle.load" not in text and "allow_pickle=True" not in text, p
