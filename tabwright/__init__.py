"""Table profiling, cleaning and supervised-learning preparation as Spark jobs."""

from tabwright.errors import TableError
from tabwright.session import configure

__version__ = "0.1.0"
__all__ = ["TableError", "configure", "__version__"]
