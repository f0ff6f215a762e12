"""Scratch tables of these operators: those of the library."""

from glotweave.scratch import Scratch, materialise, scratch_dir, scratch_path

__all__ = ["Scratch", "materialise", "scratch_dir", "scratch_path"]
