"""Order-insensitive frame comparison shared by the tests (same rules as scripts/check_oracle.py)."""

import pandas as pd


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_extension_array_dtype(s) and pd.api.types.is_integer_dtype(s) and s.isna().any():
            s = s.astype("float64")  # as pandas shows whole numbers with nulls otherwise
        if pd.api.types.is_float_dtype(s):
            df[c] = s.round(6) + 0.0
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[ns]").astype(str)
        elif len(s) and s.map(lambda v: type(v).__name__ in ("date", "datetime")).any():
            df[c] = pd.to_datetime(s).astype("datetime64[ns]").astype(str)
        else:
            df[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and v != v) else str(v))
    return df


def frames_equal(a: pd.DataFrame, b: pd.DataFrame):
    if sorted(a.columns) != sorted(b.columns):
        return False, f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    x = _norm(a).astype(str).sort_values(sorted(a.columns)).reset_index(drop=True)
    y = _norm(b).astype(str).sort_values(sorted(b.columns)).reset_index(drop=True)
    if x.equals(y):
        return True, ""
    bad = [c for c in x.columns if not x[c].equals(y[c])]
    return False, f"differing columns: {bad[:5]}"
