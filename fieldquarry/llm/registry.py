"""All queries of this subpackage with their SQL, from its modules named ``*_q``."""

from importlib import import_module
from pathlib import Path
from pkgutil import iter_modules

QUERIES: dict = {}
ORACLE: dict = {}
for _found in sorted(x.name for x in iter_modules([str(Path(__file__).parent)]) if x.name.endswith("_q")):
    _module = import_module(f"{__package__}.{_found}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
