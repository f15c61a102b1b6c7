from .fits import read_fit, write_fit  # noqa: F401
from .layers import attributes, read_layer, write_layer  # noqa: F401
from .tables import literal_table, read_table, write_text_table  # noqa: F401
