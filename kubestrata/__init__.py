"""Analytics over recorded Kubernetes API state, on Spark DataFrames."""

from kubestrata.capture import Capture
from kubestrata.session import configure

__all__ = ["Capture", "configure"]
