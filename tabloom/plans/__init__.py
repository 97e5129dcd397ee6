"""Named queries over the driver's tables."""

from . import catalogue, documents, laboratory, platform, report, texts

__all__ = ["catalogue", "documents", "laboratory", "platform", "report", "texts"]
