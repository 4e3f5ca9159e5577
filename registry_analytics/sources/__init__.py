from .csv import read_company_list, read_interactions
from .lines import (load_release, parse_lines, parse_narrow, parse_wide, read_lines,
                    read_release_table, save_release)

__all__ = ["read_company_list", "read_interactions", "load_release", "parse_lines",
           "parse_narrow", "parse_wide", "read_lines", "read_release_table", "save_release"]
