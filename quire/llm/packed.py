"""Small tables of fixed size, looked up inside expressions."""

from ..packed import FLAGS, flag, flags, look_up, numbers, packed

__all__ = ["FLAGS", "flag", "flags", "look_up", "numbers", "packed"]
