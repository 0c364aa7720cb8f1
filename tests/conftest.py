import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from memlake.session import get_spark

    return get_spark("tests", "local[4]", 3)


def rows(df, *columns):
    """The rows as sorted tuples; nulls sort first."""
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=lambda r: [(x is not None, str(x)) for x in r])
