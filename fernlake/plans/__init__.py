"""Helpers around plans: sessions, shared scratch tables, iteration."""
