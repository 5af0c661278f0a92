"""Reading and writing cubes."""

from .operators.reshape import from_frame, from_pandas, to_frame, to_pandas
from .sources.chunks import load_chunked, save_chunked, vacuum_chunked
from .sources.loaders import read_csv
from .sources.store import load, save, vacuum, versions

__all__ = ["from_frame", "from_pandas", "load", "load_chunked", "read_csv", "save", "save_chunked", "to_frame", "to_pandas", "vacuum", "vacuum_chunked", "versions"]
