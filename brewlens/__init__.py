"""Fermentation time-series analytics on Spark DataFrames."""

from brewlens.session import build_session
from brewlens.workspace import Workspace

__all__ = ["Workspace", "build_session"]
