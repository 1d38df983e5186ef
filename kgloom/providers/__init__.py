"""Model-backed table functions behind one protocol, with providers that need no network."""

from kgloom.providers.base import Provider, ProviderError, Request, Response, Usage
from kgloom.providers.registry import get_provider, list_providers

__all__ = ["Provider", "ProviderError", "Request", "Response", "Usage", "get_provider", "list_providers"]
