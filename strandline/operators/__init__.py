"""Interval operators on DataFrames with columns chrom, start, end and any others."""

from .closest import closest, closest_lists
from .complement import complement
from .coverage import coverage
from .generate import generate, generate_modes
from .genomecov import genomecov
from .intersect import intersect
from .jaccard import jaccard
from .merge import merge
from .multiinter import multiinter
from .slop import slop
from .sort import sort
from .subtract import subtract
from .window import window

__all__ = ["closest", "closest_lists", "complement", "coverage", "generate", "generate_modes", "genomecov", "intersect", "jaccard", "merge", "multiinter", "slop", "sort", "subtract", "window"]
