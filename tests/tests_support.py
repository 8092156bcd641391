import numpy as np


def table(df, key):
    """A Spark result as pandas, indexed and sorted by its key."""
    return df.toPandas().set_index(key).sort_index()


def close(got, want):
    """Equal values under equal keys, whatever the order."""
    got, want = ({str(k): v for k, v in x.astype(float).items()} for x in (got, want))
    assert sorted(got) == sorted(want)
    keys = sorted(got)
    np.testing.assert_allclose(
        [got[k] for k in keys], [want[k] for k in keys], rtol=1e-9, atol=1e-9
    )


def same_rows(first, second, digits=9):
    """Two Spark results with the same rows, doubles rounded."""

    def lines(df):
        return sorted(
            str([f"{v:.{digits}f}" if isinstance(v, float) else v for v in row])
            for row in df.collect()
        )

    assert lines(first) == lines(second)
