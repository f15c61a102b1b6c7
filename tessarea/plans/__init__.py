from .levels import LEVELS, AREA_KEYS, StudyInputs  # noqa: F401
