from firnline.sources.forms import read_folder, read_form, read_versions
from firnline.sources.tables import write_table

__all__ = ["read_folder", "read_form", "read_versions", "write_table"]
