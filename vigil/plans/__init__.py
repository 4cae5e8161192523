"""Plan-level helpers: size checks, study assembly."""
