"""Tables in the folder that the cluster shares, which survive the loss of executors."""

from __future__ import annotations

from ..storage import kept, scratch

__all__ = ["kept", "scratch"]
