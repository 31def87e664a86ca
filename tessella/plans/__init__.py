"""Plan helpers: written intermediate tables that are removed in the end, checked broadcasts."""

from tessella.plans.materialise import broadcast_if_small, materialise, scratch, shared_dir

__all__ = ["broadcast_if_small", "materialise", "scratch", "shared_dir"]
