"""haplolake: DataFrame operators for microbial sequence-variant data."""

from haplolake.session import build_session, stage

__all__ = ["build_session", "stage"]
