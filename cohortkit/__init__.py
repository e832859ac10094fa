"""cohortkit -- cohort selection and behavioural-risk scoring as lazy Spark plans."""

from .config import RunConfig, fixture_config, production_config

__all__ = ["RunConfig", "fixture_config", "production_config"]
__version__ = "0.1.0"
