from .estimator import Statistics
from .sql import Select, bind, parse_statement, run_select

__all__ = ["Select", "Statistics", "bind", "parse_statement", "run_select"]
