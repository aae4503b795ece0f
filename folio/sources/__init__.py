"""Sources of the corpus packer."""
