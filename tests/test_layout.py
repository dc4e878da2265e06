from collections import Counter
from pathlib import Path


def test_no_two_test_files_share_a_name():
    """pytest collects only one of two files with one basename in folders without packages."""
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert [n for n, times in names.items() if times > 1] == []
