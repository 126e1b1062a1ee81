"""What tests share."""

import pandas as pd

SF = "/root/testdata/sf0.001"


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame, comparable: columns and rows in order."""
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, int) else x
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).values.tolist()), key=repr)
