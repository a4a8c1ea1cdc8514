"""Named queries over the derived report tables."""


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    import importlib
    import pkgutil

    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
