"""Functions on byte chunks, by name. Importing this package registers all of them."""

from millrace.functions import asymmetric, blockwise, ciphers, codecs, compression, containers, des, formats, hashes, kdf, misc, patterns, sevenzip, strings, wallets  # noqa: F401
from millrace.functions.registry import UNITS, Unit, unit

__all__ = ["UNITS", "Unit", "unit"]
