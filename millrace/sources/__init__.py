from .tables import Tables
from .text import compose_record, console_lines, load_text, lines, scan_text, write_out

__all__ = ["Tables", "compose_record", "console_lines", "lines", "load_text", "scan_text", "write_out"]
