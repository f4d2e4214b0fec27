"""gridlake: workbook and tabular analytics as ordinary Catalyst plans."""

__version__ = "0.1.0"
