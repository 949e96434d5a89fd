"""Sources besides Parquet."""

from .delimited import read_tbl  # noqa: F401
