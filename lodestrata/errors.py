"""What the library raises on bad input."""


class LodestrataError(ValueError):
    pass


class ParseError(LodestrataError):
    """A potential or coordinate file that can't be read."""


class InvalidInput(LodestrataError):
    """Atoms, cells or parameters that break a rule."""
