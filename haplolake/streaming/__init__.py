"""Record-at-a-time operators over text that keeps arriving."""

from haplolake.streaming.follow import follow_clip_filter, follow_soft_filters

__all__ = ["follow_clip_filter", "follow_soft_filters"]
