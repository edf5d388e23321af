import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gatewarden.session import local_session

    s = local_session(4, shuffle_partitions=4, app="gatewarden-tests")
    yield s


def rows(df, *cols, order=None):
    """Collect selected columns as sorted tuples."""
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else out
