from .columns import (  # noqa: F401
    as_missing,
    censored,
    code_number,
    code_text,
    first_present,
    is_missing,
    is_present,
    log_positive,
    ratio,
    round_half_even,
    zero_replaced,
)
from .geodesy import GDA94_AUSTRALIA_LAMBERT, LambertConic, morton  # noqa: F401
from .normal import normal_upper_tail  # noqa: F401
