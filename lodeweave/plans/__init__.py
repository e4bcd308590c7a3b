"""Shared plan building blocks: materialisation, ordered numbering, size-checked broadcasts."""
