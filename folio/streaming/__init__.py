"""Streaming of the corpus packer."""
