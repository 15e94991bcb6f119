"""Rules as data: normalising, checking, compiling and keeping versions of them."""
