"""Readers and writers of the text formats."""

from haplolake.sources.readers import *  # noqa: F401,F403
from haplolake.sources.writers import *  # noqa: F401,F403
