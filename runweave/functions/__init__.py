from runweave.functions.scalars import chunk_seed, narrow_int32, overflow_int32

__all__ = ["chunk_seed", "narrow_int32", "overflow_int32"]
